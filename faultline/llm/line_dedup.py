"""Line dedup that can be extended and undone: sharded cuckoo filters before exact tables of reference counts.

Method.  A line's key is the line without white space at both ends, A-Z lower-cased, known by its 128-bit hash.  An index
holds three tables: ``references``, one row for each document and key; ``counts``, for each key the exact number of its
documents and the largest of their ids; ``filters``, for each shard of the hash space a cuckoo filter of the keys that at
least ``least_documents`` documents hold.  Inserting documents adds to the counts and puts keys that reach the number into the
filters; deleting documents subtracts and takes keys that fall below it out again, which a cuckoo filter allows, so that
later answers are those of an index that never saw these documents.  To judge documents, their keys go to the shards; only keys that
pass a filter (repeated lines and a few false positives) are looked up in the exact counts, and only what is confirmed
there is dropped.

Bounds.  A task holds one shard's filter (2.4 to 10 bytes a repeated key of the shard; at most 65,536 shards) and one batch of
keys.  Shards with more rows than twice the mean, as that of a line found everywhere, are dealt to several tasks by the documents' ids.
Of the exact counts, keys that hold more than a ``HOT``-th of all references, fewer than ``HOT`` of them, are
joined by broadcast, the others by key.  Counts are combined in the map tasks.

Defined results.  A null or empty text is one empty line.  Documents are told apart by id: rows that share an id, null
included, count as one document and lose the same keys; a null id is less than any other.  Inserting an id that the index
holds replaces that document.  Empty tables give empty indexes and results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled

#: Fixed values of the task.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)

SHARDS = 256
SLOTS = 4
FULL = 0.85
MOST_KICKS = 500
HOT = 1000

FILTER_COLUMNS = "shard int, slots binary, stash binary"
KEY = ["hi", "lo"]


def line_key(line: str) -> str:
    line = line.strip(WHITE)
    return line.lower() if line.isascii() else line.translate(TO_LOWER)


def _hashed(key: str) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"))
    return (value >> 64) - (1 << 63), (value & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _keys_of(text: str, least_length: int) -> set[tuple[int, int]]:
    return {_hashed(k) for k in {line_key(x) for x in text.split("\n") if len(x) >= least_length} if len(k) >= least_length}


def shard_of(shards: int) -> Column:
    """The shard from the key's upper half; the filter's places come from the lower one."""
    return F.pmod(F.col("hi"), F.lit(shards)).cast("int")


# --- the filter -----------------------------------------------------------------------------------------------------


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; a key has two buckets, each found from the other and the fingerprint.

    An entry that finds no place goes to a short list beside the buckets, so that inserting always succeeds.
    """

    def __init__(self, slots: np.ndarray, stash: list[int]):
        self.slots, self.stash = slots.reshape(-1, SLOTS), stash

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(4, math.ceil(math.log2(max(keys, 1) / (SLOTS * FULL))))
        return cls(np.zeros((buckets, SLOTS), np.uint16), [])

    @classmethod
    def loaded(cls, slots: bytes, stash: bytes) -> CuckooFilter:
        return cls(np.frombuffer(slots, np.uint16).copy(), np.frombuffer(stash, np.int64).tolist())

    def dumped(self) -> tuple[bytes, bytes]:
        return self.slots.tobytes(), np.array(self.stash, np.int64).tobytes()

    def _other(self, bucket, fingerprint):
        return (bucket ^ (fingerprint.astype(np.int64) * 0x5BD1E995)) & (len(self.slots) - 1)

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fingerprint = ((lo >> 40) & 0xFFFF).astype(np.uint16)
        fingerprint[fingerprint == 0] = 1
        first = (lo ^ (hi >> 24)) & (len(self.slots) - 1)
        return fingerprint, first, self._other(first, fingerprint)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        fingerprint, first, second = self._places(hi, lo)
        found = (self.slots[first] == fingerprint[:, None]).any(axis=1) | (self.slots[second] == fingerprint[:, None]).any(axis=1)
        if self.stash:
            entry = fingerprint.astype(np.int64)
            found |= np.isin(first << 16 | entry, self.stash) | np.isin(second << 16 | entry, self.stash)
        return found

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> None:
        for fingerprint, first, second in zip(*self._places(hi, lo), strict=True):
            for bucket in (first, second):
                free = np.flatnonzero(self.slots[bucket] == 0)
                if len(free):
                    self.slots[bucket, free[0]] = fingerprint
                    break
            else:
                self._push(fingerprint, second)

    def _push(self, fingerprint: np.uint16, bucket: np.int64) -> None:
        """Evict entries to their other buckets until one finds a free slot; a fixed order of victims, so a retry does the same."""
        for kick in range(MOST_KICKS):
            victim = (kick + int(fingerprint)) % SLOTS
            fingerprint, self.slots[bucket, victim] = self.slots[bucket, victim], fingerprint
            bucket = self._other(bucket, fingerprint)
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = fingerprint
                return
        self.stash.append(int(bucket) << 16 | int(fingerprint))

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Take out one entry for each of these keys, which must have been inserted."""
        for fingerprint, first, second in zip(*self._places(hi, lo), strict=True):
            for bucket in (first, second):
                entry = int(bucket) << 16 | int(fingerprint)
                if entry in self.stash:
                    self.stash.remove(entry)
                    break
                at = np.flatnonzero(self.slots[bucket] == fingerprint)
                if len(at):
                    self.slots[bucket, at[0]] = 0
                    break


FILTER, DELETE, INSERT, PROBE = 0, 1, 2, 3


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(shard, kind, rows) for the runs of equal shard and kind in each batch."""
    for batch in batches:
        shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
        change = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
        for start, stop in zip([0, *change], [*change, len(shard)], strict=True):
            if stop > start:
                yield int(shard[start]), int(kind[start]), batch.slice(start, stop - start)


def _key_arrays(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return rows.column("hi").to_numpy(), rows.column("lo").to_numpy()


def _updated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shard's filter after its deletions and insertions; one with a given ``size`` is started anew."""
    now, made = -1, None

    def finished() -> pa.RecordBatch:
        slots, stash = made.dumped()
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int32()), pa.array([slots], pa.binary()), pa.array([stash], pa.binary())],
            names=["shard", "slots", "stash"])

    for shard, kind, rows in _runs(batches):
        if kind == FILTER:
            if made is not None:
                yield finished()
            row = rows.select(["slots", "stash", "size"]).to_pylist()[0]
            now = shard
            made = CuckooFilter.loaded(row["slots"], row["stash"]) if row["size"] is None else CuckooFilter.sized(row["size"])
        else:
            (made.delete if kind == DELETE else made.insert)(*_key_arrays(rows))
    if made is not None:
        yield finished()


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The probes that pass their shard's filter."""
    now, made = -1, None
    for shard, kind, rows in _runs(batches):
        if kind == FILTER:
            row = rows.select(["slots", "stash"]).to_pylist()[0]
            now, made = shard, CuckooFilter.loaded(row["slots"], row["stash"])
        elif shard == now:
            hit = made.contains(*_key_arrays(rows))
            if hit.any():
                yield rows.select(["hi", "lo", "doc_id"]).filter(pa.array(hit))


# --- the index ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class LineIndex:
    """Written tables: references (hi, lo, doc_id), counts (hi, lo, documents, keeper), filters (shard, slots, stash)."""

    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    least_documents: int
    least_length: int
    shards: int

    def saved(self, folder: str) -> None:
        for name in ("references", "counts", "filters"):
            getattr(self, name).write.parquet(f"{folder}/{name}")
        options = self.references.sparkSession.createDataFrame(
            [(self.least_documents, self.least_length, self.shards)], "least_documents int, least_length int, shards int")
        options.write.parquet(f"{folder}/options")


def load(spark: SparkSession, folder: str) -> LineIndex:
    tables = (spark.read.parquet(f"{folder}/{name}") for name in ("references", "counts", "filters"))
    return LineIndex(*tables, *spark.read.parquet(f"{folder}/options").first())


def document_keys(docs: DataFrame, doc_id: str, text: str, least_length: int) -> DataFrame:
    """hi, lo, doc_id: the distinct keys of each document with at least ``least_length`` code points."""
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_keys_of(t, least_length) if t else () for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, keys), np.int64, len(keys))
            flat = np.array([k for each in keys for k in each], np.int64).reshape(-1, 2)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), sizes)))
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), ids], names=["hi", "lo", "doc_id"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"hi long, lo long, doc_id {kind}").distinct()


def _looked_up(rows: DataFrame, counts: DataFrame, references: int, hot: int = HOT) -> DataFrame:
    """``rows`` (hi, lo, doc_id) joined with ``counts`` by key.  ``references`` is the number of all references: a key with more than
    a ``hot``-th of them is broadcast, and there are fewer than ``hot`` such keys."""
    many = F.col("documents") > F.lit(references / hot)
    frequent = F.broadcast(counts.where(many))
    return rows.join(frequent, KEY).unionByName(
        rows.join(frequent.select(*KEY), KEY, "left_anti").join(counts.where(~many), KEY))


def _filters(counts: DataFrame, changes: DataFrame, filters: DataFrame, least_documents: int, shards: int) -> DataFrame:
    """The filters after ``changes`` (kind, hi, lo); a shard whose keys outgrow its filter gets a new one from the counts."""
    spark = counts.sparkSession
    repeated = counts.where(F.col("documents") >= least_documents).select(shard_of(shards).alias("shard"), *KEY)
    keys = repeated.groupBy("shard").agg(F.count("*").alias("keys"))
    plan = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(keys, "shard", "left").join(
        filters, "shard", "left")
    small = F.col("slots").isNull() | (F.coalesce("keys", F.lit(0)) > F.octet_length("slots") / 2 * FULL)
    plan = settled(plan.select(
        "shard", "slots", "stash", F.when(small, 2 * F.coalesce("keys", F.lit(0))).alias("size")), "lines-plan")
    anew = F.broadcast(plan.where("size IS NOT NULL").select("shard"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("slots", "binary"), ("stash", "binary"), ("size", "long"))]
    own = plan.select("shard", F.lit(FILTER).alias("kind"), F.lit(None).cast("long").alias("hi"),
                      F.lit(None).cast("long").alias("lo"), "slots", "stash", "size")
    whole = repeated.join(anew, "shard").select("shard", F.lit(INSERT).alias("kind"), *KEY, *none)
    moved = changes.select(shard_of(shards).alias("shard"), "kind", *KEY).join(anew, "shard", "left_anti").select(
        "shard", "kind", *KEY, *none)
    routed = own.unionByName(whole).unionByName(moved).repartition("shard").sortWithinPartitions("shard", "kind", *KEY)
    return settled(routed.mapInArrow(_updated, FILTER_COLUMNS), "lines-filters")


def _changed(counts: DataFrame, least: int) -> DataFrame:
    """kind, hi, lo of the keys that cross the least number of documents; ``counts`` has ``was`` and ``documents``."""
    up, down = (F.col("was") < least) & (F.col("documents") >= least), (F.col("was") >= least) & (F.col("documents") < least)
    return counts.where(up | down).select(F.when(up, INSERT).otherwise(DELETE).alias("kind"), *KEY)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_documents: int = 3, least_length: int = 20,
          shards: int = SHARDS) -> LineIndex:
    """The index of ``docs``; ``least_documents`` are at least 2, ``shards`` at most 65,536."""
    if least_documents < 2 or not 0 < shards <= 1 << 16:
        raise ValueError("least_documents is 2 or more, shards are 1 to 65,536")
    spark, kind = docs.sparkSession, docs.select(doc_id).schema[0].dataType.simpleString()
    empty = LineIndex(
        spark.createDataFrame([], f"hi long, lo long, doc_id {kind}"),
        spark.createDataFrame([], f"hi long, lo long, documents long, keeper {kind}"),
        spark.createDataFrame([], FILTER_COLUMNS), least_documents, least_length, shards)
    return _added(empty, docs, doc_id, text)


def insert(index: LineIndex, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
    """The index with ``docs``; a document whose id it holds replaces that one."""
    return _added(delete(index, docs, doc_id), docs, doc_id, text)


def _added(index: LineIndex, docs: DataFrame, doc_id: str, text: str) -> LineIndex:
    fresh = settled(document_keys(docs, doc_id, text, index.least_length), "lines-references")
    delta = fresh.groupBy(*KEY).agg(F.count("*").alias("added"), F.max("doc_id").alias("keeper"))
    both = index.counts.withColumn("added", F.lit(0).cast("long")).unionByName(
        delta.withColumn("documents", F.lit(0).cast("long")))
    counts = settled(both.groupBy(*KEY).agg(
        F.sum("documents").alias("was"), F.sum(F.col("documents") + F.col("added")).alias("documents"),
        F.max("keeper").alias("keeper")), "lines-counts")
    filters = _filters(counts, _changed(counts, index.least_documents), index.filters, index.least_documents, index.shards)
    return LineIndex(index.references.unionByName(fresh), counts.drop("was"), filters, index.least_documents,
                     index.least_length, index.shards)


def delete(index: LineIndex, ids: DataFrame, doc_id: str = "doc_id") -> LineIndex:
    """The index as if the documents with these ids had never been inserted; unknown ids change nothing."""
    out = ids.select(F.col(doc_id).alias("_out")).distinct()
    marked = index.references.join(out, F.col("doc_id").eqNullSafe(F.col("_out")), "left_semi")
    gone = settled(marked, "lines-gone")
    if gone.isEmpty():
        return index
    live = settled(index.references.join(out, F.col("doc_id").eqNullSafe(F.col("_out")), "left_anti"), "lines-references")
    removed = gone.groupBy(*KEY).agg(F.count("*").alias("removed"))
    both = index.counts.withColumn("removed", F.lit(0).cast("long")).unionByName(
        removed.select(*KEY, F.lit(0).cast("long").alias("documents"),
                       F.lit(None).cast(index.counts.schema["keeper"].dataType).alias("keeper"), "removed"))
    left = settled(both.groupBy(*KEY).agg(
        F.sum("documents").alias("was"), F.sum(F.col("documents") - F.col("removed")).alias("documents"),
        F.max("keeper").alias("keeper")), "lines-counts")
    touched = left.where("documents < was AND documents > 0").select(*KEY, "documents")
    keepers = _looked_up(live, touched, live.count()).groupBy(*KEY).agg(F.max("doc_id").alias("keeper"))
    renewed = left.where("documents < was AND documents > 0").drop("keeper").join(keepers, KEY)
    counts = settled(left.where("documents = was").unionByName(renewed).drop("was"), "lines-counts")
    filters = _filters(counts, _changed(left, index.least_documents), index.filters, index.least_documents, index.shards)
    return LineIndex(live, counts, filters, index.least_documents, index.least_length, index.shards)


# --- judging documents ----------------------------------------------------------------------------------------------


def repeated_keys(index: LineIndex, references: DataFrame) -> DataFrame:
    """hi, lo, doc_id, documents, keeper: of ``references``, those whose key enough documents hold."""
    shard = shard_of(index.shards)
    loads = references.groupBy(shard.alias("shard")).agg(F.count("*").alias("rows"))
    mean = (references.count() or 1) / index.shards
    dealt = F.broadcast(settled(
        loads.select("shard", F.ceil(F.col("rows") / F.lit(2 * mean)).cast("int").alias("tasks")), "lines-loads"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("slots", "binary"), ("stash", "binary"))]
    probes = references.withColumn("shard", shard).join(dealt, "shard").select(
        "shard", F.pmod(F.xxhash64("doc_id"), F.col("tasks")).cast("int").alias("task"), F.lit(PROBE).alias("kind"), *KEY,
        "doc_id", *none)
    kind = references.schema["doc_id"].dataType
    own = index.filters.join(dealt, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(FILTER).alias("kind"),
        F.lit(None).cast("long").alias("hi"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast(kind).alias("doc_id"),
        "slots", "stash")
    routed = own.unionByName(probes).repartition("shard", "task").sortWithinPartitions("shard", "task", "kind")
    hits = settled(routed.mapInArrow(_passed, references.select(*KEY, "doc_id").schema), "lines-hits")
    enough = index.counts.where(F.col("documents") >= index.least_documents)
    return _looked_up(hits, enough, hits.count())


def without_repeated_lines(index: LineIndex, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                           references: DataFrame | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, text: each document without the lines that enough documents of the index hold.

    The document with the largest id that holds a key keeps its lines.  ``references`` are the documents' keys, where they are
    known already.
    """
    if references is None:
        references = settled(document_keys(docs, doc_id, text, index.least_length), "lines-probed")
    drops = repeated_keys(index, references).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lists = drops.groupBy(F.col("doc_id").alias("_of")).agg(F.collect_list(F.struct(*KEY)).alias("drops"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    joined = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("_of")), "left").select("doc_id", "text", "drops")
    least = index.least_length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, dropped, kept = [], [], []
            for value, listed in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                parts = (value or "").split("\n")
                lines.append(len(parts))
                if listed.is_valid:
                    pairs = listed.values
                    out = set(zip(pairs.field(0).to_pylist(), pairs.field(1).to_pylist(), strict=True))
                    left = [p for p in parts if len(p) < least or len(k := line_key(p)) < least or _hashed(k) not in out]
                    kept.append("\n".join(left))
                    dropped.append(len(parts) - len(left))
                else:
                    kept.append(value or "")
                    dropped.append(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, text string")
