"""Similarity join of texts on five-word shingles by chosen paths.

1. A text is its set of hashed shingles.  Rows with equal sets are one class, represented by one row from here on.
2. Each set has a signature of ``HASHES`` min-hashes, the tokens that paths choose from: two sets of Jaccard similarity J
   agree in each with probability J.
3. A run starts with all sets in one node.  A node chooses, by a hash of its path, one of the tokens or (in a quarter of all cases) two, and
   a set goes to the child named by its value there; 1.25 children a set on average, so two sets at the threshold 0.8 are
   expected to stay together in one.  Nodes three levels down are taken as buckets; with J = 0.8 a run brings a pair together with
   probability 0.64, eight runs with 0.9997; with J = 0.9 eight runs miss 1 pair in a million.  (Of 20,000 simulated pairs at 0.8 one was missed.)
4. Buckets of more than ``BUCKET`` sets are split further by the same rule, up to ``DEEPER`` levels.  Every level loses pairs: seven down
   eight runs keep 0.992 of those at 0.8.  So all sets of such buckets go through ``HOT_RUNS`` more runs, 24 in all, which
   keep 0.99995 there (simulated likewise).  What does not get smaller (near copies of one text) is dealt into tiles of that size, every two tiles meeting in one group.  In each group all pairs are compared by
   their signatures, and those that agree in ``LEAST_AGREEMENT`` of the tokens (4 standard deviations below the threshold) are linked; only a
   spanning forest of the links leaves the group.
5. The linked sets' connected components are small and hold every likely pair.  The texts of their members are read again, and within
   each component (again in tiles) all pairs are compared by their exact similarity.  A link counts from ``similarity`` on.

No bucket, component or class is ever collected in one task beyond two tiles, no pairs are shuffled, and copies are never paired.  What
grows with the square of its size is a group of near copies with different texts, in tiles spread over the cluster.

Result: one row for each document with ``class_id``, the least document id among those linked directly or over others,
and ``links``, the number of other documents at the threshold or above (copies included).

Defined results: a text without words, or null, links to nothing and is its own class; a text of one to four words is one
shingle; words are runs of letters, digits and underscores in lower case; rows that repeat an id are documents of
their own; null ids sort last, and a class of null ids alone has a null class id.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TokenCodes, components, held, mixed, settled, shingle_codes, text_pieces

WIDTH, SIMILARITY = 5, 0.8
HASHES, RUNS, DEPTH, SECOND_CHILD, LEAST_AGREEMENT = 128, 8, 3, 0.25, 0.66
BUCKET, DEEPER, HOT_RUNS, TILE, PIECE_CHARS = 512, 4, 16, 256, 2_000_000


def tokens() -> TokenCodes:
    return held(("jaccard_join",), lambda: TokenCodes(re.compile(r"\w+").findall))


@functools.lru_cache(maxsize=1)
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_240_601)
    return draw.integers(0, 2**32, HASHES, np.uint32) | np.uint32(1), draw.integers(0, 2**32, HASHES, np.uint32)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    codes, bounds = tokens().codes(texts)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield np.unique(shingle_codes(codes[a:b], WIDTH))


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each min-hash."""
    a, b = multipliers()
    x = ((shingles >> np.uint64(32)) ^ shingles).astype(np.uint32)
    least = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for part in range(0, len(x), 2_048):
        h = x[part:part + 2_048, None] * a + b
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        np.minimum(least, h.min(axis=0), out=least)
    return (mixed(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype("<u2")


def set_rows(docs: DataFrame, text: str) -> DataFrame:
    """kept (all columns of ``docs``), the set's key (null if it is empty) and its signature."""
    rows = docs.select(F.struct(*docs.columns).alias("kept"))
    schema = rows.select("kept", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(b"").alias("signature")).schema
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.column(0)
            texts = kept.field(text).to_pylist()
            for start, end in text_pieces(texts, PIECE_CHARS):
                keys: list[list[int | None]] = [[], []]
                signatures: list[bytes | None] = []
                for one in shingle_sets(texts[start:end]):
                    key = one.astype("<u8").tobytes()
                    for out, seed in zip(keys, (1, 2), strict=True):
                        out.append(xxhash.xxh64_intdigest(key, seed) - 2**63 if key else None)
                    signatures.append(signature(one).tobytes() if key else None)
                yield pa.RecordBatch.from_arrays(
                    [kept.slice(start, end - start), *[pa.array(k, pa.int64()) for k in keys], pa.array(signatures, pa.binary())],
                    names=["kept", "k1", "k2", "signature"])

    return rows.mapInArrow(run, schema)


def children(paths: np.ndarray, owners: np.ndarray, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level down: the children's paths and the sets in them."""
    draw = mixed(paths)
    first = draw % np.uint64(HASHES)
    second = (first + np.uint64(1) + (draw >> np.uint64(20)) % np.uint64(HASHES - 1)) % np.uint64(HASHES)
    twice = (draw >> np.uint64(40)) % np.uint64(1_000) < np.uint64(int(SECOND_CHILD * 1_000))
    out = []
    for choice, mask in ((first, slice(None)), (second, twice)):
        at, who, path = choice[mask].astype(np.int64), owners[mask], paths[mask]
        value = signatures[who, at].astype(np.uint64)
        out.append((mixed(path * np.uint64(0x9E3779B97F4A7C15) + (at.astype(np.uint64) << np.uint64(16)) + value), who))
    return np.concatenate([p for p, _ in out]), np.concatenate([w for _, w in out])


def unpacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


def first_buckets(reps: DataFrame, runs: range, depth: int = DEPTH) -> DataFrame:
    """leaf, rep for every bucket ``depth`` levels down in every run (numbered from 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures, reps_here = unpacked(batch.column("signature")), batch.column("rep").to_numpy()
            n = len(reps_here)
            paths = np.repeat(mixed(np.array(runs, np.uint64)), n)
            owners = np.tile(np.arange(n), len(runs))
            for _ in range(depth):
                paths, owners = children(paths, owners, signatures)
            yield leaf_batch(paths, reps_here[owners])

    return reps.select("rep", "signature").mapInArrow(run, "leaf long, rep long")


def leaf_batch(paths: np.ndarray, reps: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([paths.view(np.int64), reps]), axis=1) if len(reps) else np.zeros((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["leaf", "rep"])


def next_buckets(rows: DataFrame) -> DataFrame:
    """The buckets one level below those of ``rows`` (leaf, rep, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column("rep").to_numpy()
            paths, owners = children(
                batch.column("leaf").to_numpy().view(np.uint64), np.arange(len(reps)), unpacked(batch.column("signature")))
            yield leaf_batch(paths, reps[owners])

    return rows.select("leaf", "rep", "signature").mapInArrow(run, "leaf long, rep long")


def sized(leaves: DataFrame) -> DataFrame:
    """leaf, rep, size without buckets of one set.  Sizes are counted in the map tasks and joined, so a hot bucket can be split."""
    sizes = leaves.groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1")
    return leaves.join(sizes, "leaf")


def in_tiles(rows: DataFrame, key: str, size: str, member: str, tile: int) -> DataFrame:
    """Adds ``a`` and ``b``: each row once for every two tiles of its group that its own tile meets in."""
    tiles = F.ceil(F.col(size) / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(11), member, key), tiles).cast("int")
    other = F.explode(F.sequence(F.lit(0), tiles - 1))
    dealt = rows.withColumn("own", own).withColumn("other", other)
    return dealt.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("other")


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of sorted rows."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            key = tuple(c[start] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each member's component under the links i - j."""
    root = np.arange(n)
    while len(i):
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], least)
        np.minimum.at(root, root[j], least)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def likely_links(rows: DataFrame) -> DataFrame:
    """a, b: a spanning forest of the likely links in each group of ``rows`` (leaf, a, b, own, rep, signature)."""

    def links(group, own, across, reps, x) -> np.ndarray:
        found, apart = [], 1
        at = np.flatnonzero(group[1:] == group[:-1])
        while len(at):
            met = ~across[at] | (own[at] != own[at + apart])
            some = at[met]
            for part in range(0, len(some), 65_536):
                i = some[part:part + 65_536]
                i = i[(x[i] == x[i + apart]).mean(axis=1) >= LEAST_AGREEMENT]
                found.append(np.stack([i, i + apart]))
            apart += 1
            at = at[at + apart < len(group)]
            at = at[group[at] == group[at + apart]]
        i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        root = forest(len(group), i, j)
        joined = np.flatnonzero(root != np.arange(len(group)))
        return np.unique(np.stack([reps[joined], reps[root[joined]]]), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch] if batch is not None else held) if held or batch is not None else None
            if table is None:
                continue
            leaf, a, b = (table.column(c).to_numpy() for c in ("leaf", "a", "b"))
            new = np.r_[True, (leaf[1:] != leaf[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            # The last group may go on in the next batch; a group has two tiles at most.
            whole = len(leaf) if batch is None else int(np.flatnonzero(new)[-1])
            held = table.slice(whole).to_batches() if batch is not None else []
            if whole:
                part = table.slice(0, whole)
                found = links(
                    np.cumsum(new[:whole]), part.column("own").to_numpy(), a[:whole] != b[:whole],
                    part.column("rep").to_numpy(), unpacked(part.column("signature")))
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    dealt = rows.repartition("leaf", "a", "b").sortWithinPartitions("leaf", "a", "b")
    return dealt.select("leaf", "a", "b", "own", "rep", "signature").mapInArrow(run, "a long, b long").where("a <> b").distinct()


def candidate_links(reps: DataFrame, runs: int) -> DataFrame:
    """Edges (a, b) that connect all sets which some bucket finds likely to be linked."""
    signatures = reps.select("rep", "signature")
    leaves = first_buckets(reps, range(1, runs + 1))
    found = []
    for depth in range(DEEPER + 1):
        here = settled(sized(leaves).join(signatures, "rep"), f"join-buckets-{depth}")
        small = here if depth == DEEPER else here.where(F.col("size") <= BUCKET)
        found.append(settled(likely_links(in_tiles(small, "leaf", "size", "rep", BUCKET)), f"join-links-{depth}"))
        large = here.where(F.col("size") > BUCKET)
        if depth == DEEPER or large.isEmpty():
            break
        leaves = next_buckets(large)
        if not depth:
            hot = settled(large.select("rep").distinct().join(signatures, "rep"), "join-hot")
            leaves = leaves.unionByName(first_buckets(hot, range(runs + 1, runs + HOT_RUNS + 1), DEPTH + 1))
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the shingles that at least two sets hold."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[place] > 1
    number = np.cumsum(times > 1) - 1
    place, owner = number[place[shared]], owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((n, n), np.float32)
    step = 4_096
    for low in range(0, int((times > 1).sum()), step):
        a, b = np.searchsorted(place, [low, low + step])
        block = np.zeros((n, step), np.float32)
        block[owner[a:b], place[a:b] - low] = 1
        out += block @ block.T
    return out


def exact_links(members: DataFrame, similarity: float) -> DataFrame:
    """rep, links, root of each group: copies' numbers of the sets linked there, and the least set of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        for group in groups_of(batches, ["cluster", "a", "b"]):
            n = group.num_rows
            if n < 2:
                continue
            reps, copies, own = (group.column(c).to_numpy() for c in ("rep", "copies", "own"))
            order = np.argsort(reps)
            reps, copies, own = reps[order], copies[order], own[order]
            packed = group.column("shingles").to_pylist()
            sets = [np.frombuffer(packed[i], "<u8") for i in order]
            both = common_counts(sets).astype(float)
            sizes = np.array([len(s) for s in sets], float)
            linked = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-6
            np.fill_diagonal(linked, False)
            if group.column("a")[0].as_py() != group.column("b")[0].as_py():
                linked &= own[:, None] != own[None, :]
            root = forest(n, *np.nonzero(np.triu(linked)))
            some = np.flatnonzero(linked.any(axis=1))
            out.append(np.stack([reps[some], (linked[some] @ copies).astype(np.int64), reps[root[some]]]))
        rows = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["rep", "links", "root"])

    dealt = members.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b")
    return dealt.select("cluster", "a", "b", "own", "rep", "copies", "shingles").mapInArrow(run, "rep long, links long, root long")


def shingled(rows: DataFrame) -> DataFrame:
    """Replaces the column ``text`` by the packed set of shingles."""
    rest = [c for c in rows.columns if c != "text"]
    schema = rows.select(*rest, F.lit(b"").alias("shingles")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in text_pieces(texts, PIECE_CHARS):
                packed = [s.astype("<u8").tobytes() for s in shingle_sets(texts[start:end])]
                piece = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c) for c in rest], pa.array(packed, pa.binary())], names=[*rest, "shingles"])

    return rows.select(*rest, "text").mapInArrow(run, schema)


def similarity_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
                    runs: int = RUNS) -> tuple[DataFrame, DataFrame]:
    """The written rows (kept, k1, k2, row) and what is found of each class (k1, k2, class_id, first_row, links)."""
    rows = settled(set_rows(docs, text).withColumn("row", F.monotonically_increasing_id()), "join-sets")
    named = F.struct(F.col("kept")[doc_id].isNull().alias("no_id"), F.col("kept")[doc_id].cast("long").alias("id"), "row")
    reps = settled(
        rows.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(
            F.min("row").alias("rep"), F.count("*").alias("copies"), F.min(named).alias("first"),
            F.min("signature").alias("signature")),
        "join-classes",
    )
    edges = settled(candidate_links(reps, runs), "join-edges")
    clusters = settled(components(edges, "join-clusters").select(
        F.col("node").alias("rep"), F.col("root").alias("cluster")), "join-members")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    wanted = clusters.join(sizes, "cluster").join(reps.select("rep", "copies"), "rep")
    texts = rows.select(F.col("row").alias("rep"), F.col("kept")[text].alias("text")).join(wanted, "rep")
    links = settled(exact_links(in_tiles(shingled(texts), "cluster", "size", "rep", TILE), similarity), "join-exact")
    sums = links.groupBy("rep").agg(F.sum("links").alias("others"))
    joined = components(links.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), "join-groups")
    grouped = reps.select("k1", "k2", "rep", "copies", "first").join(
        joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    firsts = grouped.groupBy("root").agg(F.min("first").alias("least"))
    return rows, grouped.join(firsts, "root").join(sums, "rep", "left").select(
        "k1", "k2", F.col("least.id").alias("class_id"), F.col("least.row").alias("first_row"),
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))


def linked_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the text plus class_id and links."""
    rows, classes = similarity_join(docs, doc_id, text, **options)
    rest = [c for c in docs.columns if c not in (text, "class_id", "links")]
    kept = [F.col("kept")[c].alias(c) for c in rest]
    narrow = rows.select(F.struct(*kept).alias("kept"), F.col("kept")[doc_id].cast("long").alias("own"), "k1", "k2")
    worded = narrow.where("k1 IS NOT NULL").join(classes, ["k1", "k2"]).select("kept", "class_id", "links")
    alone = narrow.where("k1 IS NULL").select("kept", F.col("own").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return worded.unionByName(alone).select("kept.*", "class_id", "links")


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: the least id's.  Rows without words stay."""
    rows, classes = similarity_join(docs, doc_id, text, **options)
    firsts = classes.select(F.col("first_row").alias("row")).distinct()
    kept = rows.where("k1 IS NOT NULL").select("row", "kept").join(firsts, "row", "left_semi").select("kept.*")
    return kept.unionByName(rows.where("k1 IS NULL").select("kept.*"))
