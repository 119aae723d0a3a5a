"""Quality by importance resampling.

Texts are bags of hashed n-grams: words and runs of symbols, their pairs, and for a token that repeats the one
before it a mark of its own, in ``buckets`` classes.  One generative model is counted over a target (texts labelled good), one
over the raw corpus; the log importance weight of a text is the sum of ``log(target / raw)`` over its n-grams.  The
target's model is shrunk to the raw one by ``shrink`` pseudo-counts, so n-grams that it says little about weigh little.

Texts are then drawn without replacement in proportion to their weights: each gets a Gumbel variate from the hash of its
row key, and the k largest sums of log weight and variate are the sample.  The quality classifier takes as k the number
of texts whose log weight is at least ``least``.  Measured on tables of 200 to 15,000 texts, before toxicity counts: texts
labelled good have log weights from -24 up, those of bad quality at most -30 but for 1 in 100, the median below -280.

A few toxic words do not move a mean over all n-grams, so a second pair of models is counted over texts labelled toxic and
labelled clean: in how many of them each word occurs.  A text's toxicity is the sum of its ``TELLING`` largest log ratios of
the two, and what it exceeds a bar by, times ``TEMPER``, is taken from its log weight.  The bar is the one that parts the
labelled texts, each judged by all others, with the fewest errors.  A toxic text without words that toxic texts share is
not recognised and stays.

The raw counts cover all rows.  The target's model is fitted on at most ``TARGET_ROWS`` labelled rows, chosen by the hash of
their id, and so are those of toxic and of clean texts; these ids and the counts are all that is broadcast.  The k-th largest sum is found by histograms that narrow down, so
nothing is sorted or collected but counts.

Defined results: null and empty texts, and all texts if no row is labelled good, have log weight 0; a document with several labels is
good if all say so and toxic if one does; a null label is none; without texts labelled toxic, or clean, no text is toxic; rows that agree in key and weight are drawn together.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TokenCodes, held, mixed, settled, text_pieces

BUCKETS, SHRINK, TARGET_ROWS, PIECE_CHARS = 10_000, 50.0, 20_000, 2_000_000
TEMPER, NEUTRAL_GRAMS, LEAST_LOG_WEIGHT = 1_000.0, 200, -28.0
WORD_BUCKETS, TELLING = 1 << 20, 3
HISTOGRAM = 4_096


def tokens() -> TokenCodes:
    return held(("resampling",), lambda: TokenCodes(re.compile(r"\w+|[^\w\s]+").findall))


def grams(codes: np.ndarray, starts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every n-gram."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    left, right = codes[:-1], codes[1:]
    pair = np.where(left == right, np.uint64(0), mixed(left * np.uint64(3) + right))
    inside = owner[:-1] == owner[1:]
    all_grams = np.r_[mixed(codes), pair[inside]]
    return (all_grams % np.uint64(buckets)).astype(np.int64), np.r_[owner, owner[:-1][inside]]


def good_label() -> Column:
    """Over labels: of good quality and not toxic."""
    return (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)


def words_held(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every word, once for each text that holds it."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    cells = np.unique(owner * WORD_BUCKETS + (mixed(codes) % np.uint64(WORD_BUCKETS)).astype(np.int64))
    return cells // WORD_BUCKETS, cells % WORD_BUCKETS


def toxic_label() -> Column:
    """Over labels: toxic; null if the label does not say."""
    return F.col("toxic") == 1


def target_ids(labels: DataFrame, good: Column, doc_id: str = "doc_id", rows: int = TARGET_ROWS) -> frozenset:
    """Ids of at most ``rows`` documents of which all labels are good."""
    good_ids = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(
        F.min(F.coalesce(good, F.lit(False))).alias("good")).where("good").select("id")
    return frozenset(r["id"] for r in good_ids.orderBy(F.xxhash64("id"), "id").limit(rows).collect())


def toxic_and_clean_ids(labels: DataFrame, toxic: Column, doc_id: str = "doc_id",
                        rows: int = TARGET_ROWS) -> tuple[frozenset, frozenset]:
    """Ids of at most ``rows`` documents that some label calls toxic, and of as many that all labels call clean."""
    known = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(toxic).alias("toxic"))
    return tuple(
        frozenset(r["id"] for r in known.where(which).select("id").orderBy(F.xxhash64("id"), "id").limit(rows).collect())
        for which in ("toxic", "NOT toxic"))


@dataclass(frozen=True)
class ToxicWords:
    """Numbers of toxic and of clean texts, in all and by the words they hold (words of one toxic text are left out)."""

    toxic: np.ndarray
    clean: np.ndarray
    texts: tuple[int, int]
    ids: tuple[frozenset, frozenset]
    bar: float = np.inf

    @functools.cached_property
    def telling(self) -> np.ndarray:
        """Of each bucket whether its ratio may be above 1, with one clean text less."""
        clean = np.maximum(self.clean - 1, 0)
        return (self.toxic > 1) & ((self.toxic + 1) * max(self.texts[1], 1) > self.texts[0] * clean)

    def scores(self, ids: list, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Toxicity of each text, by the counts of all others."""
        bucket = (mixed(codes) % np.uint64(WORD_BUCKETS)).astype(np.int64)
        some = np.flatnonzero(self.telling[bucket])
        owner = np.searchsorted(starts, some, side="right") - 1
        cells = np.unique(owner * WORD_BUCKETS + bucket[some])
        owner, bucket = cells // WORD_BUCKETS, cells % WORD_BUCKETS
        own = [np.array([i in side for i in ids], np.int64)[owner] for side in self.ids]
        toxic, clean = self.toxic[bucket] - own[0], self.clean[bucket] - own[1]
        expected = (self.texts[0] - own[0]) * (clean + 1) / (self.texts[1] - own[1] + 1)
        ratio = np.where(toxic > 1, np.log((toxic + 1) / (expected + 1)), 0)
        order = np.lexsort((-ratio, owner))
        owner, ratio = owner[order], np.maximum(ratio[order], 0)
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        return np.bincount(owner[rank < TELLING], ratio[rank < TELLING], len(ids))


def best_bar(scores: np.ndarray, toxic: np.ndarray, times: np.ndarray) -> float:
    """The bar above 0 with the fewest toxic texts below and clean texts above it, of equal ones the highest."""
    values = np.unique(np.r_[0.0, scores])
    at = np.searchsorted(values, scores)
    missed = np.cumsum(np.bincount(at, times * toxic, len(values)))
    dropped = np.cumsum(np.bincount(at, times * ~toxic, len(values))[::-1])[::-1]
    errors = np.r_[missed[:-1] + dropped[1:], missed[-1]]
    best = len(values) - 1 - int(errors[::-1].argmin())
    return (values[best] + values[best + 1]) / 2 if best + 1 < len(values) else np.inf


@dataclass(frozen=True)
class NGramModels:
    """Counts of every bucket in the target and in the raw corpus, and the words of toxic texts."""

    target: np.ndarray
    raw: np.ndarray
    targets: frozenset
    toxic_words: ToxicWords | None = None

    def log_weights(self, ids: list, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log weight and number of n-grams of each text, by the counts of all others."""
        buckets, n = len(self.raw), len(texts)
        codes, starts = tokens().codes(texts)
        found, owner = grams(codes, starts, buckets)
        cells, times = np.unique(owner * buckets + found, return_counts=True)
        owner, bucket = cells // buckets, cells % buckets
        sizes = np.bincount(owner, times, n)
        toxicity = np.zeros(n)
        if self.toxic_words is not None:
            toxicity = TEMPER * np.maximum(self.toxic_words.scores(ids, codes, starts) - self.toxic_words.bar, 0)
        if not len(self.targets):
            return 0.0 - toxicity, sizes.astype(np.int64)
        chosen = np.array([i in self.targets for i in ids], bool)
        own_size = sizes[owner]
        target = self.target[bucket] - np.where(chosen[owner], times, 0)
        total = self.target.sum() - np.where(chosen[owner], own_size, 0)
        others = np.maximum(self.raw.sum() - own_size, 1)
        expected = total * (self.raw[bucket] - times) / others
        ratio = np.log((target + SHRINK) / (expected + SHRINK))
        return TEMPER * np.bincount(owner, times * ratio, n) / (sizes + NEUTRAL_GRAMS) - toxicity, sizes.astype(np.int64)


def count_models(docs: DataFrame, targets: frozenset, doc_id: str = "doc_id", text: str = "text",
                 buckets: int = BUCKETS, toxic_clean: tuple[frozenset, frozenset] = (frozenset(), frozenset())) -> NGramModels:
    """Counts over all rows, summed in the map tasks.  Above the n-grams' buckets come those of words, in which ``target``
    counts toxic texts and ``raw`` clean ones, and then the number of these texts."""
    shared = docs.sparkSession.sparkContext.broadcast((targets, *toxic_clean))  # at most TARGET_ROWS ids each
    judging = all(toxic_clean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = buckets + (WORD_BUCKETS + 1 if judging else 0)
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, end in text_pieces(texts, PIECE_CHARS):
                codes, starts = tokens().codes(texts[start:end])
                found, owner = grams(codes, starts, buckets)
                chosen, toxic, clean = (np.array([i in side for i in ids[start:end]], bool) for side in shared.value)
                raw[:buckets] += np.bincount(found, minlength=buckets)
                target[:buckets] += np.bincount(found[chosen[owner]], minlength=buckets)
                if judging and (toxic | clean).any():
                    labelled = np.repeat(toxic | clean, np.diff(starts))
                    held_by, word = words_held(codes[labelled], np.r_[0, np.cumsum(np.where(toxic | clean, np.diff(starts), 0))])
                    for out, side in ((target, toxic), (raw, clean)):
                        np.add.at(out, buckets + word[side[held_by]], 1)
                        out[-1] += side.sum()
        seen = np.flatnonzero(raw + target)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])],
                                         names=["bucket", "raw", "target"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets + WORD_BUCKETS + 1), np.zeros(buckets + WORD_BUCKETS + 1)
    for r in rows.where((F.col("bucket") < buckets) | (F.col("target") > 1) | (F.col("bucket") == buckets + WORD_BUCKETS)).collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    words = None
    if target[-1] and raw[-1]:
        toxic, clean = (x[buckets:-1].astype(np.int32) for x in (target, raw))
        words = with_bar(docs, ToxicWords(toxic, clean, (int(target[-1]), int(raw[-1])), toxic_clean), doc_id, text)
    return NGramModels(target[:buckets], raw[:buckets], targets, words)


def with_bar(docs: DataFrame, words: ToxicWords, doc_id: str, text: str) -> ToxicWords:
    """``words`` with the bar of the labelled rows; the scores that come back are at most as many as their ids and copies."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic_ids, clean_ids = shared.value.ids
        for batch in batches:
            chosen = batch.filter(pa.array([i in toxic_ids or i in clean_ids for i in batch.column(0).to_pylist()], pa.bool_()))
            ids, texts = chosen.column(0).to_pylist(), chosen.column(1).to_pylist()
            for start, end in text_pieces(texts, PIECE_CHARS):
                scores = shared.value.scores(ids[start:end], *tokens().codes(texts[start:end]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.round(scores, 6)), pa.array([i in toxic_ids for i in ids[start:end]], pa.bool_())], names=["score", "toxic"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "score double, toxic boolean").groupBy("score", "toxic").count().collect()
    scores, toxic, times = (np.array([r[c] for r in rows], kind) for c, kind in (("score", float), ("toxic", bool), ("count", float)))
    return replace(words, bar=best_bar(scores, toxic, times))


def weighted(docs: DataFrame, models: NGramModels, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` (without the text unless asked) plus log_weight and n_grams."""
    rest = [c for c in docs.columns if (keep_text or c != text) and c not in ("log_weight", "n_grams")]
    rows = docs.select(*rest, *([] if keep_text else [text]))
    schema = T.StructType([*[f for f in rows.schema if f.name in rest], *T.StructType.fromDDL("log_weight double, n_grams long")])
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(doc_id).to_pylist(), batch.column(text).to_pylist()
            for start, end in text_pieces(texts, PIECE_CHARS):
                weights, sizes = shared.value.log_weights(ids[start:end], texts[start:end])
                piece = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c) for c in rest], pa.array(weights), pa.array(sizes)],
                    names=[*rest, "log_weight", "n_grams"])

    return rows.mapInArrow(run, schema)


def gumbel(*key: Column, seed: int = 0) -> Column:
    """A standard Gumbel variate from the hash of the key."""
    high = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double")
    return -F.log(-F.log((high + 0.5) / F.lit(2.0**53)))


def gumbel_top_k(rows: DataFrame, perturbed: str, k: int, flag: str = "sampled") -> DataFrame:
    """``rows`` (a written table) plus whether a row is among the k largest of ``perturbed``; equal values go together."""
    bar = kth_largest(rows.select(F.col(perturbed).alias("x")), k)
    if bar is None:
        return rows.withColumn(flag, F.lit(False))
    return rows.withColumn(flag, F.col(perturbed) >= F.lit(bar))


def kth_largest(values: DataFrame, k: int) -> float | None:
    """The k-th largest of the column ``x`` (the least, if there are fewer), by histograms of a shrinking range."""
    edge = values.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n")).first()
    if k < 1 or not edge["n"]:
        return None
    low, high, above = edge["low"], edge["high"], 0
    if k >= edge["n"]:
        return low
    while True:
        width = (high - low) / HISTOGRAM
        if width <= 0 or low + width == low:
            return low
        bin_of = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(width)), F.lit(HISTOGRAM - 1))
        bins = values.where(F.col("x").between(low, high)).groupBy(bin_of.alias("bin")).agg(
            F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        for row in sorted(bins, key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                break
            above += row["n"]
        if row["low"] == row["high"] or (row["low"], row["high"]) == (low, high):
            return row["low"]
        low, high = row["low"], row["high"]


def resample(docs: DataFrame, labels: DataFrame, good: Column, doc_id: str = "doc_id", text: str = "text",
             least: float = LEAST_LOG_WEIGHT, seed: int = 0, keep_text: bool = False, toxic: Column | None = None) -> DataFrame:
    """``docs`` plus n_grams, log_weight, perturbed and sampled.  Without ``toxic`` no text is toxic."""
    docs = docs.drop("perturbed", "sampled")
    toxic_clean = (frozenset(), frozenset()) if toxic is None else toxic_and_clean_ids(labels, toxic)
    models = count_models(docs, target_ids(labels, good), doc_id, text, toxic_clean=toxic_clean)
    noise = gumbel(F.col(doc_id).cast("string"), seed=seed)
    rows = settled(weighted(docs, models, doc_id, text, keep_text).withColumn("perturbed", F.col("log_weight") + noise), "weighted")
    return gumbel_top_k(rows, "perturbed", rows.where(F.col("log_weight") >= least).count())
