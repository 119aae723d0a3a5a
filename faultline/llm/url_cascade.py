"""URL rules by a cascade of Bloom filters, with DataFrame functions only.

A rule is a host and the start of a path.  It fits a url whose host is the rule's or a subdomain of it and whose path
starts with the rule's; the longest fitting rule wins.  Every url therefore *names* the few keys that could list it: each
suffix of its host, followed by the start of its path in each length that some rule's path has.  A url is judged by
asking which of its keys are listed.

The listed keys are held as a cascade.  Level 1 is a Bloom filter of the listed keys.  Level 2 holds the corpus's keys
that are not listed and yet pass level 1; level 3 the listed keys that pass level 2; and so on until a level lets nothing
wrong through.  Over the keys of the corpus it was built for, a key is listed exactly if the first level that refuses it
is an even one, so judging needs no join.  The first filter's error rate is set from the number of the corpus's keys, so
that about as many keys reach level 2 as are listed: the whole cascade takes some ``log2(keys / listed)`` bits a listed
key, however long the corpus is.  A list whose cascade would be over ``most_bits`` is looked up by a shuffled join.

Defined results: a null url or one without ``://`` has empty host and path and no rule; a url without rule gets
``default``; rows are never merged or lost; a rule listed twice counts once, and one listed with both verdicts blocks;
null rules are no rules; an empty list gives every url the default.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

#: Bits of one filter, 1 MB; its words are a literal in the plan.
MOST_BITS = 1 << 23
#: Levels before the builder gives up; with halving errors this is far beyond any list that fits.
MOST_LEVELS = 60
VERDICTS = ("allow", "block")


def host_of(url: Column) -> Column:
    """The part after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key that a rule fitting the url could have."""
    labels = F.split(host, "[.]", -1)
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels) - i), "."))
    starts = F.filter(
        F.transform(F.array(*[F.lit(n) for n in lengths]),
                    lambda n: F.when(F.char_length(path) >= n, F.substring(path, F.lit(1), n))),
        lambda s: s.isNotNull(),
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` positions in 64-bit words, ``hashes`` positions a key."""

    words: tuple[int, ...]
    bits: int
    hashes: int
    seed: int

    def has(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        return F.forall(
            positions(key, self.bits, self.hashes, self.seed),
            lambda p: F.get(words, F.shiftright(p, 6).cast("int")).bitwiseAND(one_bit(p)) != 0,
        )


def positions(key: Column, bits: int, hashes: int, seed: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(seed * 64 + i), key), F.lit(bits)) for i in range(hashes)])


def one_bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position.bitwiseAND(F.lit(63)).cast("int"))


def bloom_level(keys: DataFrame, count: int, error: float, seed: int) -> Level:
    """The filter of the column ``key``.  Bits are or-ed in the map tasks, so a hot key costs nothing."""
    bits, hashes = shape(count, error)
    found = (
        keys.select(F.explode(positions(F.col("key"), bits, hashes, seed)).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(one_bit(F.col("p"))).alias("mask")).collect()
    )
    words = [0] * (bits // 64)
    for row in found:  # at most bits / 64 rows
        words[row["word"]] = row["mask"]
    return Level(tuple(words), bits, hashes, seed)


def shape(count: int, error: float) -> tuple[int, int]:
    """Bits (whole words) and hashes of a filter of ``count`` keys."""
    each = math.log(1 / error) / math.log(2) ** 2
    return max(64, math.ceil(count * each / 64) * 64), max(1, round(each * math.log(2)))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def lists(self, key: Column) -> Column:
        """Whether ``key`` is listed: the first level that refuses it is an even one, or none of an odd number does."""
        if not self.levels:
            return F.lit(False)
        verdict = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            verdict = F.when(~level.has(key), F.lit(i % 2 == 1)).otherwise(verdict)
        return verdict


def build_cascade(listed: DataFrame, universe: DataFrame, seed: int = 0, most_bits: int = MOST_BITS) -> Cascade | None:
    """The cascade of the column ``key`` of ``listed`` over those of ``universe``; None if a filter would be too large.

    The universe is read once.  Only its keys that pass the first filter are shuffled, and later levels read these alone.
    """
    members = settled(listed.select("key").where("key IS NOT NULL").distinct(), "cascade-listed")
    count = members.count()
    if not count:
        return Cascade(())
    total = max(universe.select(F.approx_count_distinct("key")).first()[0], count)
    error = min(0.5, count / total)
    if shape(count, error)[0] > most_bits:
        return None
    levels = [bloom_level(members, count, error, seed)]
    strangers = settled(
        universe.select("key").where(levels[0].has(F.col("key"))).distinct().join(members, "key", "left_anti"),
        "cascade-strangers",
    )
    sides = [strangers, members]
    while len(levels) < MOST_LEVELS:
        side = sides[(len(levels) + 1) % 2]
        for level in levels[(len(levels) + 1) % 2::2]:
            side = side.where(level.has(F.col("key")))
        wrong = side.count()
        if not wrong:
            return Cascade(tuple(levels))
        if shape(wrong, 0.5)[0] > most_bits:
            return None
        levels.append(bloom_level(side, wrong, 0.5, seed + len(levels)))
    return None


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", most_bits: int = MOST_BITS) -> DataFrame:
    """``pages`` (with ``url``) plus host, path, rule and verdict.  ``rules`` has host, path and verdict."""
    kept = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isin(*VERDICTS))
    keyed = settled(
        # A-Z alone, as for the urls.
        kept.select(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), "path", "verdict")
        .select(F.concat("host", "path").alias("key"), F.char_length("path").alias("n"), "verdict")
        .groupBy("key", "n").agg(F.max("verdict").alias("verdict")),
        "url-rules",
    )
    # Distinct lengths of paths: a short list, whatever the number of rules.
    lengths = sorted(r["n"] for r in keyed.select("n").distinct().collect())
    judged = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if not lengths:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    universe = judged.select(F.explode(keys_of(F.col("host"), F.col("path"), lengths)).alias("key"))
    cascades = {
        v: build_cascade(keyed.where(F.col("verdict") == v), universe, 1000 * i, most_bits)
        for i, v in enumerate(VERDICTS)
    }
    if any(c is None for c in cascades.values()):
        return judge_by_join(judged, keyed, lengths, default)
    keys = keys_of(F.col("host"), F.col("path"), lengths)
    fits = F.concat(*[
        F.transform(F.filter(F.col("keys"), c.lists), fit_of(v))
        for v, c in cascades.items()
    ])
    return with_verdict(
        judged.withColumn("keys", keys).withColumn("fit", F.array_max(fits)).drop("keys"), default)


def longest(key: Column, verdict: Column) -> Column:
    return F.struct(F.char_length(key).alias("n"), key.alias("key"), verdict.alias("verdict"))


def fit_of(verdict: str):
    return lambda key: longest(key, F.lit(verdict))


def with_verdict(judged: DataFrame, default: str) -> DataFrame:
    return judged.withColumns({
        "rule": F.col("fit.key"), "verdict": F.coalesce(F.col("fit.verdict"), F.lit(default)),
    }).drop("fit")


def judge_by_join(judged: DataFrame, keyed: DataFrame, lengths: list[int], default: str) -> DataFrame:
    """The same for lists too long for filters: distinct keys are looked up, and the fits go back by host and path."""
    urls = judged.select("host", "path").distinct()
    fits = (
        urls.withColumn("key", F.explode(keys_of(F.col("host"), F.col("path"), lengths)))
        .join(keyed.select("key", "verdict"), "key")
        .groupBy("host", "path").agg(F.max(longest(F.col("key"), F.col("verdict"))).alias("fit"))
    )
    return with_verdict(judged.join(fits, ["host", "path"], "left").select(*judged.columns, "fit"), default)
