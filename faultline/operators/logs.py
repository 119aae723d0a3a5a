"""Log classification: matches, key lines, snippets.

Two shapes of input.  ``task_logs`` holds one row per attempt with the whole text: everything is a projection of that
row, so there is no shuffle at all.  ``log_lines`` holds one row per line, for logs too large for one row: everything
is a map-side combined aggregate or a top-k there, so one log may hold a third of all lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.functions import signatures as sig
from faultline.functions.text import WHITE_SPACE, pinned, split_lines, strip
from faultline.session import settled

# Words that mark a line as part of the error, and the limits around them.
ERROR_KEYWORDS = ["error", "exception", "traceback", "failed", "oom", "killed", "timeout"]
LINES_BEFORE, LINES_AFTER, TAIL_LINES, TAIL_CHARS, TRUNCATED_ABOVE, KEY_LINES = 5, 10, 50, 2000, 100_000, 10


def has_error_keyword(line: Column) -> Column:
    """The lower-cased line holds a keyword (the Kelvin sign is the only other letter that lowers to ASCII)."""
    return line.rlike(sig.any_word(ERROR_KEYWORDS, {"k": "\u212a"}))


def error_snippet(text: Column, before: int = LINES_BEFORE, after: int = LINES_AFTER, tail: int = TAIL_LINES) -> Column:
    """Lines from 5 before the first keyword line up to 9 after the last one; without any, the last 50 lines."""
    return snippet_of_lines(split_lines(strip(text)), before, after, tail)


def snippet_of_lines(lines: Column, before: int = LINES_BEFORE, after: int = LINES_AFTER, tail: int = TAIL_LINES) -> Column:
    """The snippet of the stripped text's lines, which are evaluated once."""
    part = lambda one: _snippet_of(one, before, after, tail)
    return F.when(lines.isNotNull(), F.get(F.transform(F.array(lines), part), F.lit(0)))


def _snippet_of(lines: Column, before: int, after: int, tail_lines: int) -> Column:
    hits = F.transform(lines, has_error_keyword)
    count = F.size(lines)
    first = F.array_position(hits, True).cast("int")
    last = count + 1 - F.array_position(F.reverse(hits), True).cast("int")
    begin = F.greatest(F.lit(1), first - before)
    end = F.least(count, last + after - 1)
    around = F.slice(lines, begin, end - begin + 1)
    tail_begin = F.greatest(F.lit(1), count - tail_lines + 1)
    tail = F.slice(lines, tail_begin, count - tail_begin + 1)
    return F.array_join(F.when(first > 0, around).otherwise(tail), "\n")


def tail_chars(text: Column, count: int = TAIL_CHARS) -> Column:
    return F.substring(text, -count, count)


def profile_logs(logs: DataFrame, text: str = "stdout", before: int = LINES_BEFORE, after: int = LINES_AFTER,
                 tail: int = TAIL_LINES) -> DataFrame:
    """Adds log_lines, truncated, error_snippet and the always-null stderr.  The text is stripped and split once."""
    body = F.col(text)
    return pinned(logs, _stripped=split_lines(strip(body))).withColumns({
        "stderr": F.lit(None).cast("string"),
        "log_lines": F.size("_stripped"),
        "truncated": F.char_length(body) > TRUNCATED_ABOVE,
        "error_snippet": snippet_of_lines(F.col("_stripped"), before, after, tail),
    }).drop("_stripped")


def match_logs(logs: DataFrame, text: str = "stdout", custom=None, with_key_lines: bool = True,
               key_lines: int = KEY_LINES) -> DataFrame:
    """Adds ``matches`` (families in severity order) and ``key_log_lines`` to each log.

    Where no regex can cross lines, one pass over the text keeps the few lines that hold any signature's literal, and
    the regexes read only these.
    """
    families = sig.catalogue(custom)
    body = F.col(text)
    if sig.is_linewise(families):
        rows = pinned(logs, _lines=sig.candidate_lines(body, families))
        rows = pinned(rows, _text=F.array_join("_lines", "\n"))
    else:
        rows = logs.withColumn("_lines", split_lines(body)).withColumn("_text", body)
    rows = pinned(rows, _folded=sig.folded(F.col("_text")))
    out = {"matches": sig.family_matches("_text", "_folded", families)}
    if with_key_lines:
        out["key_log_lines"] = sig.key_lines(F.col("_lines"), families, key_lines)
    return pinned(rows, **out).drop("_lines", "_text", "_folded")


def match_signatures(logs: DataFrame, ids: list[str], text: str = "stdout", custom=None) -> DataFrame:
    """One row per (log, family) that occurs in it, most severe first (``position``)."""
    matched = match_logs(logs.select(*ids, text), text, custom, with_key_lines=False)
    return matched.select(*ids, F.posexplode("matches").alias("position", "family")).select(
        *ids, "position", "family.*", F.size("family.matches").alias("n_matches")
    )


def primary_error(logs: DataFrame, ids: list[str], text: str = "stdout", custom=None) -> DataFrame:
    """The most severe family of each log, nulls where nothing matches."""
    matched = match_logs(logs.select(*ids, text), text, custom, with_key_lines=False)
    return matched.select(*ids, F.get("matches", F.lit(0)).alias("primary"))


def signature_frequency(logs: DataFrame, group: str, text: str = "stdout", custom=None) -> DataFrame:
    """Logs, matches and distinct ``group`` values per family.

    Counted per (family, group) first, so a hot family arrives as one row per group and map task.
    """
    rows = match_signatures(logs, [group], text, custom)
    per_group = rows.groupBy("sig_idx", "name", "category", "severity", group).agg(
        F.count("*").alias("n"), F.sum("n_matches").alias("m")
    )
    return per_group.groupBy("sig_idx", "name", "category", "severity").agg(
        F.sum("n").alias("n_logs"), F.sum("m").alias("n_matches"), F.count(group).alias("n_groups")
    )


def explode_lines(logs: DataFrame, ids: list[str], text: str = "stdout", stripped: bool = True) -> DataFrame:
    """One row per line, numbered from 0.  Snippets number the stripped text, key lines the raw one."""
    body = strip(F.col(text)) if stripped else F.col(text)
    return logs.select(*ids, F.posexplode(split_lines(body)).alias("line_no", "line"))


# --- line-wise input -------------------------------------------------------------------------------------------------


def line_matches(lines: DataFrame, ids: list[str], custom=None) -> DataFrame:
    """One row per match of a line-wise log, with the (rx_idx, line_no, pos) that orders it within its family."""
    families = sig.catalogue(custom)
    for signature in families:
        for regex in signature.regexes:
            if not sig.is_plain(regex):
                raise ValueError(f"{regex!r} may cross lines or is anchored: match whole texts instead")
    hits = lines.select(*ids, "line_no", "line").where(sig.any_signature(F.col("line"), families))
    found = F.array(*[
        F.struct(
            F.lit(index).alias("sig_idx"), F.lit(s.name).alias("name"), F.lit(s.severity).alias("severity"),
            F.lit(rx).alias("rx_idx"),
            F.regexp_extract_all("line", F.lit(sig.DIALECT + regex), F.lit(0)).alias("found"),
        )
        for index, s in sig.ranked(families) for rx, regex in enumerate(s.regexes)
    ])
    exploded = hits.select(*ids, "line_no", F.explode(found).alias("hit"))
    return exploded.select(
        *ids, "line_no", "hit.sig_idx", "hit.name", "hit.severity", "hit.rx_idx",
        F.posexplode("hit.found").alias("pos", "match"),
    )


def line_key_lines(lines: DataFrame, ids: list[str], custom=None, limit: int = KEY_LINES) -> DataFrame:
    """The first ``limit`` matching lines per log.  Each map task keeps at most ``limit`` rows per log."""
    hits = lines.where(sig.any_signature(F.col("line"), sig.catalogue(custom)))
    rank = F.row_number().over(Window.partitionBy(*ids).orderBy("line_no"))
    return (
        hits.select(*ids, "line_no", strip(F.col("line")).alias("line"))
        .withColumn("rank", rank).where(F.col("rank") <= limit)
    )


def line_snippet(lines: DataFrame, ids: list[str]) -> DataFrame:
    """The snippet's lines per log: bounds by a combined aggregate, then a filter by join on the log."""
    hit_no = F.when(has_error_keyword(F.col("line")), F.col("line_no"))
    bounds = lines.groupBy(*ids).agg(
        F.min(hit_no).alias("_first"), F.max(hit_no).alias("_last"), F.max("line_no").alias("_end")
    )
    low = F.when(F.col("_first").isNull(), F.col("_end") + 1 - TAIL_LINES).otherwise(F.col("_first") - LINES_BEFORE)
    high = F.coalesce(F.col("_last") + LINES_AFTER - 1, F.col("_end"))
    return (
        lines.join(bounds.select(*ids, low.alias("_low"), high.alias("_high")), ids)
        .where(F.col("line_no").between(F.col("_low"), F.col("_high")))
        .select(*ids, "line_no", "line")
    )


def profile_lines(
    lines: DataFrame, ids: list[str], before: int = LINES_BEFORE, after: int = LINES_AFTER, tail: int = TAIL_LINES,
    custom=None, key_lines: int = KEY_LINES, snippet_lines: int | None = None,
) -> DataFrame:
    """What ``profile_logs`` and ``match_logs`` say of a log, from its lines, one row for each log of ``ids``.

    ``lines`` (ids, line_no, line) are the text's lines in any order.  Nothing needs a log's lines in one place: bounds and
    lengths are combined aggregates; key lines, tail and snippet are cut to what they list in the map tasks.  Families list all
    their matches and snippets hold all their lines, as those of whole texts do.  Only a caller who gives ``snippet_lines`` gets the
    first and last half of a longer snippet, with a line between them that says how many are left out.
    """
    families = sig.catalogue(custom)
    line, no = F.col("line"), F.col("line_no")
    # Of the stripped text: its first and last line that is not blank, and the keyword lines, which lie between them.
    written = F.when(F.char_length(strip(line)) > 0, no)
    hit = F.when(has_error_keyword(line), no)
    bounds = lines.groupBy(*ids).agg(
        F.min(written).alias("_from"), F.max(written).alias("_to"), F.min(hit).alias("_first"), F.max(hit).alias("_last"),
        (F.sum(F.char_length(line)) + F.count("*") - 1).alias("_chars"), F.max("line_no").alias("_end"))
    low = F.greatest("_from", F.coalesce(F.col("_first") - before, F.col("_to") + 1 - tail))
    high = F.least("_to", F.coalesce(F.col("_last") + after - 1, F.col("_to")))
    bounds = settled(bounds.withColumns({"_low": low, "_high": high}), "log-bounds")

    placed = lines.join(bounds.select(*ids, "_from", "_to", "_low", "_high"), ids).where(no.between(F.col("_low"), F.col("_high")))
    # The stripped text has no white space before its first line and after its last one.
    shown = F.when(no == F.col("_from"), F.ltrim(line, F.lit(WHITE_SPACE))).otherwise(line)
    shown = F.when(no == F.col("_to"), F.rtrim(shown, F.lit(WHITE_SPACE))).otherwise(shown)
    if snippet_lines is not None:
        half, long = snippet_lines // 2, F.col("_high") - F.col("_low") >= snippet_lines
        placed = placed.where(~long | (no < F.col("_low") + half) | (no > F.col("_high") - half))
        gap = F.col("_high") - F.col("_low") + 1 - 2 * half
        cut = long & (no == F.col("_low") + half - 1)
        shown = F.when(cut, F.concat(shown, F.lit("\n... "), gap.cast("string"), F.lit(" lines left out ..."))).otherwise(shown)
    snippets = placed.select(*ids, F.struct(no, shown.alias("text")).alias("_l")).groupBy(*ids).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("_l")), lambda x: x["text"]), "\n").alias("error_snippet"))

    at_end = F.row_number().over(Window.partitionBy(*ids).orderBy(no.desc()))
    tails = (
        lines.select(*ids, "line_no", tail_chars(line).alias("line")).withColumn("_n", at_end).where(F.col("_n") <= TAIL_CHARS + 1)
        .groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_t"))
        .select(*ids, tail_chars(F.array_join(F.transform("_t", lambda x: x["line"]), "\n")).alias("stdout_tail")))

    # Read by the key lines and by the matches.
    hits = settled(lines.where(sig.any_signature(line, families)).select(*ids, "line_no", "line"), "log-hits")
    keys = line_key_lines(hits, ids, custom, key_lines).groupBy(*ids).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("key_log_lines"))
    order = ["rx_idx", "line_no", "pos"]
    per_family = line_matches(hits, ids, custom).groupBy(*ids, "sig_idx").agg(
        F.sort_array(F.collect_list(F.struct(*order, "match"))).alias("_m"))
    found = F.map_from_entries(F.collect_list(F.struct("sig_idx", F.transform("_m", lambda x: x["match"]).alias("m"))))
    # The families in severity order, as for whole texts.
    listed_families = F.filter(F.array(*[
        F.struct(
            F.lit(index).alias("sig_idx"), F.lit(s.name).alias("name"), F.lit(s.category).alias("category"),
            F.lit(s.severity).alias("severity"), F.lit(s.description).alias("description"),
            F.lit(s.recommendation).alias("recommendation"), F.get(F.array("_found"), F.lit(0))[F.lit(index)].alias("matches"))
        for index, s in sig.ranked(families)
    ]), lambda family: family["matches"].isNotNull())
    matched = per_family.groupBy(*ids).agg(found.alias("_found")).select(
        *ids, listed_families.cast(sig.MATCH_TYPE).alias("matches"))

    none = F.array().cast("array<string>")
    joined = bounds
    for part in (snippets, tails, matched, keys):
        joined = joined.join(part, ids, "left")
    return joined.select(
        *ids, F.coalesce((F.col("_to") - F.col("_from") + 1).cast("int"), F.lit(1)).alias("log_lines"),
        (F.col("_chars") > TRUNCATED_ABOVE).alias("truncated"), F.coalesce("error_snippet", F.lit("")).alias("error_snippet"),
        F.coalesce("matches", F.array().cast(sig.MATCH_TYPE)).alias("matches"),
        F.coalesce("key_log_lines", none).alias("key_log_lines"), F.coalesce("stdout_tail", F.lit("")).alias("stdout_tail"))

