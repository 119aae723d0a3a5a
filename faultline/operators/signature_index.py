"""Catalogues of any number of signatures: a table of regexes, found through their literals.

``logs.match_logs`` writes each regex into the plan, which serves tens of families.  Here the catalogue stays a table.  Every regex has
a literal that each match must hold, and the literal one gram of a few letters, the one that the fewest literals share.  A line's
grams are joined with these, so a line meets only regexes of which it holds a gram, and runs only those whose
whole literal it holds.  The plan has the same size whatever the catalogue's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.functions import signatures as sig
from faultline.session import settled

GRAM = 4
LEAST_LITERAL = 3
#: Regexes of a catalogue that is broadcast, some 200 bytes each; lines are shuffled, once for each of their grams, only for larger ones.
BROADCAST_REGEXES = 50_000

# The rules of ``sig.is_plain`` and ``sig.required_literal``, for a column.
PLAIN = r"^(?:[A-Za-z0-9_ /'\-]|\\\.|\.\*|\\d(?:\{\d+\})?)+$"
OPEN_PART = r"\.\*|\\d(?:\{\d+\})?"


def literal_of(regex: Column) -> Column:
    """The longest plain piece of a plain regex, lower-cased; null where there is none that is long enough."""
    pieces = F.transform(F.split(regex, OPEN_PART), lambda p: F.replace(p, F.lit("\\."), F.lit(".")))
    longest = F.aggregate(pieces, F.lit(""), lambda a, p: F.when(F.char_length(p) > F.char_length(a), p).otherwise(a))
    return F.when(regex.rlike(PLAIN) & (F.char_length(longest) >= LEAST_LITERAL), F.lower(longest))


def grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` letters, in one pass: a substring at every place would read the text from its start each time."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def build_signature_index(catalogue: DataFrame) -> DataFrame:
    """The catalogue (as ``signature_catalog`` gives it) with ``literal`` and ``gram`` of each regex, as a written table.

    A regex without a literal of three plain letters, with an anchor, group or class, cannot be indexed and is an error: such
    families go to ``match_logs``.
    """
    rows = catalogue.withColumn("literal", literal_of(F.col("regex")))
    bad = rows.where("literal IS NULL").select("name", "regex").limit(3).collect()
    if bad:
        raise ValueError(f"no literal to index in {[(r.name, r.regex) for r in bad]}: match these with match_logs")
    unknown = catalogue.where(~F.col("severity").isin(sig.SEVERITIES) | ~F.col("category").isin(sig.CATEGORIES))
    if not unknown.isEmpty():
        raise ValueError("unknown category or severity in the catalogue")
    size = F.least(F.char_length("literal"), F.lit(GRAM))
    offered = rows.select("sig_idx", "rx_idx", F.explode(
        F.when(size == GRAM, grams(F.col("literal"), GRAM)).otherwise(grams(F.col("literal"), LEAST_LITERAL))).alias("gram"))
    shared = offered.groupBy("gram").agg(F.count("*").alias("n"))
    chosen = offered.join(shared, "gram").groupBy("sig_idx", "rx_idx").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    return settled(rows.join(chosen, ["sig_idx", "rx_idx"]), "signature-index")


def indexed_matches(lines: DataFrame, ids: list[str], index: DataFrame) -> DataFrame:
    """One row per match, as ``logs.line_matches`` gives them: ids, line_no, sig_idx, name, severity, rx_idx, pos, match."""
    folded = sig.folded(F.col("line"))
    sizes = {r["size"]: r["count"] for r in index.groupBy(F.char_length("gram").alias("size")).count().collect()}
    offered = F.flatten(F.array(*[grams(F.col("_folded"), size) for size in sorted(sizes)])) if sizes else F.array().cast("array<string>")
    rules = index.select("gram", "literal", "sig_idx", "rx_idx", "regex", "name", "severity")
    rules = F.broadcast(rules) if sum(sizes.values()) <= BROADCAST_REGEXES else rules
    rows = lines.select(*ids, "line_no", "line", folded.alias("_folded")).select("*", F.explode(offered).alias("gram"))
    meeting = rows.join(rules, "gram").where(F.contains("_folded", "literal"))
    found = F.regexp_extract_all("line", F.concat(F.lit(sig.DIALECT), F.col("regex")), F.lit(0))
    return meeting.select(
        *ids, "line_no", "sig_idx", "name", "severity", "rx_idx", F.posexplode(found).alias("pos", "match"))


def indexed_families(lines: DataFrame, ids: list[str], index: DataFrame, limit: int = 10) -> DataFrame:
    """One row per (log, family): n_matches, the first ``limit`` matches in (regex, line, position) order, and the family's
    ``position`` in the log, most severe first, ties in catalogue order."""
    order = ["rx_idx", "line_no", "pos"]
    hits = indexed_matches(lines, ids, index)
    counts = hits.groupBy(*ids, "sig_idx", "name", "severity").agg(F.count("*").alias("n_matches"))
    first = F.row_number().over(Window.partitionBy(*ids, "sig_idx").orderBy(*order))
    listed = hits.withColumn("_n", first).where(F.col("_n") <= limit).groupBy(*ids, "sig_idx").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(*order, "match"))), lambda m: m["match"]).alias("matches"))
    rank = F.array_position(F.array(*[F.lit(s) for s in sig.SEVERITIES]), F.col("severity"))
    place = F.row_number().over(Window.partitionBy(*ids).orderBy(rank, "sig_idx")) - 1
    return counts.join(listed, [*ids, "sig_idx"]).withColumn("position", place)
