"""Small text and number formats, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# White space as str.strip sees it, Unicode White_Space plus the four information separators.
_SPACE_CODES = [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
    0x3000,
]
WHITE_SPACE = "".join(map(chr, _SPACE_CODES))

SEVERITY_EMOJI = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🟢"}


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns as a one-row generator.

    A filter on a plain projected column is pushed below it, which repeats the whole expression in the filter (and
    again for every reference inside it).  A filter on a generator's output stays above.
    """
    return df.select("*", F.inline(F.array(F.struct(*[col.alias(name) for name, col in columns.items()]))))


def strip(text: Column) -> Column:
    """Remove white space at both ends, in time linear in the text (a regex with an anchor at the end is not)."""
    return F.trim(text, F.lit(WHITE_SPACE))


def split_lines(text: Column) -> Column:
    """Split on line feeds only; empty lines stay."""
    return F.split(text, "\n", -1)


def first_line(text: Column) -> Column:
    return F.get(split_lines(strip(text)), F.lit(0))


def truthy(value: Column) -> Column:
    """A text or array that is neither null nor empty."""
    return value.isNotNull() & (F.length(value) > 0)


def non_empty(value: Column) -> Column:
    return F.when(truthy(value), value)


def has_items(array: Column) -> Column:
    return F.coalesce(F.size(array) > 0, F.lit(False))


def fixed(value: Column, digits: int) -> Column:
    """A number with ``digits`` decimals, rounded half to even on its exact binary value.

    format_string rounds half up on the shortest decimal text; format_number does not.
    """
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def percent(value: Column, digits: int = 0) -> Column:
    return F.concat(fixed(value * 100, digits), F.lit("%"))


def signed_percent(value: Column, digits: int = 1) -> Column:
    return F.concat(F.when(value >= 0, F.lit("+")).otherwise(F.lit("")), fixed(value, digits), F.lit("%"))


def number_text(value: Column) -> Column:
    """Shortest text of a double, switching to an exponent below 1e-4 and from 1e16 on (Spark: 1e-3 and 1e7)."""
    plain = value.cast("string")
    magnitude = F.abs(value)
    decimals = F.regexp_replace(value.cast("decimal(38,20)").cast("string"), r"0+$", "")
    long_form = F.when(decimals.endswith("."), F.concat(decimals, F.lit("0"))).otherwise(decimals)
    mantissa = F.regexp_replace(F.regexp_extract(plain, r"^(.*)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(plain, r"E(-?\d+)$", 1).cast("string")
    digits = F.regexp_replace(exponent, "-", "")
    sign = F.when(exponent.startswith("-"), F.lit("-")).otherwise(F.lit("+"))
    scientific = F.concat(mantissa, F.lit("e"), sign, F.lpad(digits, 2, "0"))
    scientific = F.when(F.length(digits) > 2, F.concat(mantissa, F.lit("e"), sign, digits)).otherwise(scientific)
    return (
        F.when(~plain.contains("E"), plain)
        .when((magnitude >= 1e-4) & (magnitude < 1e16), long_form)
        .otherwise(scientific)
    )


def number_or_na(value: Column) -> Column:
    """Zero counts as missing."""
    return F.when(value.isNull() | (value == 0), F.lit("N/A")).otherwise(number_text(value))


def text_or(value: Column, default: str) -> Column:
    """An empty text counts as missing."""
    return F.coalesce(non_empty(value), F.lit(default))


def instant_text(ts: Column) -> Column:
    """Instant with offset; the fraction only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    fraction = F.date_format(ts, ".SSSSSS")
    return F.concat(whole, F.when(fraction == ".000000", "").otherwise(fraction), F.lit("+00:00"))


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'")


def parse_instant(text: Column, wall_clock: bool = False) -> Column:
    """ISO text to an instant; ``wall_clock`` drops the offset without converting."""
    if wall_clock:
        return text.try_cast("timestamp_ntz").cast("timestamp")
    return F.try_to_timestamp(text)


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def severity_emoji(severity: Column) -> Column:
    out = F.lit("")
    for name, emoji in reversed(SEVERITY_EMOJI.items()):
        out = F.when(severity == name, F.lit(emoji)).otherwise(out)
    return out


def severity_badge(severity: Column) -> Column:
    known = severity.isin(list(SEVERITY_EMOJI))
    return F.when(known, F.concat_ws(" ", severity_emoji(severity), F.upper(severity))).otherwise(severity)
