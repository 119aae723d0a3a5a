"""Benchmark passages in documents, by SimHash windows of the items' sizes.

An item and a window of a document are compared as multisets of five-word shingles (of all words, for an item with fewer)
weighted by ``log(1 + items / items that hold the shingle)``; their similarity is the weighted Jaccard coefficient, and a
window matches an item from ``similarity`` on.  Windows have the item's number of words (the whole document, if it is shorter).

1. Fingerprints: bit j of a window's 64-bit SimHash is the sign of the weighted sum of its shingles' bits j.  All windows of a
   document come from running sums, one subtraction a window.  A window in which shingles of items of its size weigh less
   than ``similarity`` times its weight cannot match (the common weight is at most the first, the joint weight at least
   the second) and needs no fingerprint; this bound loses nothing.
2. Multi-index: the 64 bits are cut in ``radius + 1`` blocks.  Two fingerprints that differ in at most ``radius`` bits agree
   in a block, so looking up each block finds all items within the radius; the distance is then checked.
3. Candidates are verified by their exact similarity.  Passages at similarity 0.8 differ in 9.7 bits on average (standard deviation 2.9),
   so the default radius of 18 misses about 2 in 1,000 of the least similar ones and none of the near-exact ones.

The items' index is sent to the workers, in slices of at most ``SLICE_WORDS`` words; a larger benchmark takes one pass over the
documents for each slice.  Documents are never shuffled.

Defined results: null or empty texts and items match nothing; words are runs of letters, digits and underscores in lower
case; equal items match alike; items without id count as one item, reported with a null id; of a document and item the best window is reported, ties to the first; repeated
rows are reported again.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TokenCodes, held, shingle_codes, text_pieces

WIDTH, SIMILARITY, RADIUS, SLICE_WORDS, PIECE_CHARS = 5, 0.8, 18, 2_000_000, 2_000_000
MATCH = "item_id long, first_word long, words long, similarity double"


def memory() -> dict:
    """What a worker keeps from task to task: the tokens' codes, and the index of one slice of items with the slice's name."""
    return held(("decontamination",), lambda: {"tokens": TokenCodes(re.compile(r"\w+").findall), "slice": (None, None)})


def tokens() -> TokenCodes:
    return memory()["tokens"]


def item_index(name: str, items: list[tuple[int, str]], width: int, similarity: float, radius: int) -> ItemIndex:
    kept = memory()
    if kept["slice"][0] != name:
        kept["slice"] = (name, ItemIndex(items, width, similarity, radius))
    return kept["slice"][1]


def bit_signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 64 bits, a row a shingle."""
    bits = np.unpackbits(np.ascontiguousarray(shingles).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.float64) * 2 - 1


def packed(signs: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of rows of sums."""
    return np.packbits(signs > 0, axis=1, bitorder="little").view("<u8").ravel()


class MultiIndex:
    """Fingerprints by each of ``radius + 1`` blocks of bits."""

    def __init__(self, fingerprints: np.ndarray, radius: int):
        self.fingerprints, self.radius, self.blocks = fingerprints, radius, []
        for low, high in zip(*(np.linspace(0, 64, radius + 2).astype(int)[s] for s in (slice(-1), slice(1, None))), strict=True):
            values = self.block(fingerprints, low, high)
            order = np.argsort(values, kind="stable")
            self.blocks.append((low, high, order, values[order]))

    @staticmethod
    def block(x: np.ndarray, low: int, high: int) -> np.ndarray:
        return (x >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (query, fingerprint) places that differ in at most ``radius`` bits."""
        found = []
        for low, high, order, values in self.blocks:
            wanted = self.block(queries, low, high)
            first, last = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
            n = last - first
            query = np.repeat(np.arange(len(queries)), n)
            place = order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            found.append(query * len(self.fingerprints) + place)
        pairs = np.unique(np.concatenate(found))
        query, place = pairs // len(self.fingerprints), pairs % len(self.fingerprints)
        near = np.bitwise_count(queries[query] ^ self.fingerprints[place]) <= self.radius
        return query[near], place[near]


class ItemIndex:
    """The items of one slice: weights of shingles, and fingerprints by length."""

    def __init__(self, items: list[tuple[int, str]], width: int, similarity: float, radius: int):
        self.width, self.similarity = width, similarity
        codes, starts = tokens().codes([text for _, text in items])
        shingled = [shingle_codes(codes[a:b], width) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        lengths = np.diff(starts)
        holders = Counter(s for one in shingled for s in np.unique(one).tolist())
        self.codes = np.array(sorted(holders), np.uint64)
        self.common = math.log(1 + len(items))
        self.weights = np.log(1 + len(items) / np.array([holders[s] for s in self.codes.tolist()], float))
        # Of each code the sizes of the items that hold it.
        place = [np.searchsorted(self.codes, one) for one in shingled]
        pairs = np.unique(np.concatenate(
            [np.stack([at, np.full(len(at), n)], axis=1) for at, n in zip(place, lengths.tolist(), strict=True)]
            + [np.zeros((0, 2), np.int64)]), axis=0)
        self.sizes = pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.codes) + 1))
        self.lengths: dict[int, tuple[MultiIndex, list[int], list[Counter]]] = {}
        for length in sorted(set(lengths.tolist()) - {0}):
            chosen = np.flatnonzero(lengths == length)
            sums = np.array([(self.weigh(shingled[i])[:, None] * bit_signs(shingled[i])).sum(0) for i in chosen])
            self.lengths[length] = (
                MultiIndex(packed(np.round(sums, 9)), radius), [items[i][0] for i in chosen], [Counter(shingled[i].tolist()) for i in chosen])
        self.widths = sorted({min(width, length) for length in self.lengths})

    def weigh(self, shingles: np.ndarray) -> np.ndarray:
        """A shingle that no item holds weighs as one that one item holds."""
        if not len(self.codes):
            return np.full(len(shingles), self.common)
        at = np.minimum(np.searchsorted(self.codes, shingles), len(self.codes) - 1)
        return np.where(self.codes[at] == shingles, self.weights[at], self.common)

    def alike(self, a: Counter, b: Counter) -> float:
        keys = sorted(a.keys() | b.keys())
        weight = dict(zip(keys, self.weigh(np.array(keys, np.uint64)).tolist(), strict=True))
        both = sum(weight[s] * min(a[s], b[s]) for s in keys)
        return both / sum(weight[s] * max(a[s], b[s]) for s in keys)

    def windows(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per size of items: the size, shingles a window, all shingles, and starts and fingerprints of the windows kept."""
        for width in self.widths:
            shingles = shingle_codes(words, width)
            if not len(shingles):
                continue
            at = np.minimum(np.searchsorted(self.codes, shingles), len(self.codes) - 1)
            known = np.flatnonzero(self.codes[at] == shingles)
            if not len(known):
                continue
            counts = self.first[at[known] + 1] - self.first[at[known]]
            place = np.repeat(known, counts)
            ends = np.cumsum(counts)
            sizes = self.sizes[np.repeat(self.first[at[known]] - (ends - counts), counts) + np.arange(len(place))]
            weights = self.weigh(shingles)
            whole = np.r_[0, np.cumsum(weights)]
            bits = None
            for length in np.unique(sizes).tolist():
                if min(self.width, length) != width:
                    continue
                held = np.zeros(len(shingles))
                held[place[sizes == length]] = weights[place[sizes == length]]
                hits = np.r_[0, np.cumsum(held)]
                n = min(max(length - width + 1, 1), len(shingles))
                starts = np.flatnonzero(hits[n:] - hits[:-n] >= self.similarity * (whole[n:] - whole[:-n]) * (1 - 1e-9))
                if len(starts):
                    if bits is None:
                        bits = np.vstack([np.zeros((1, 64)), np.cumsum(weights[:, None] * bit_signs(shingles), axis=0)])
                    yield length, n, shingles, starts, packed(np.round(bits[starts + n] - bits[starts], 9))

    def matches(self, documents: list[np.ndarray]) -> list[list[tuple[int, int, int, float]]]:
        """Of each document (its words' codes) the items it holds: item id, first word, words and similarity of the best
        window.  The windows of all documents are looked up together, size by size."""
        kept: dict[int, list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for d, words in enumerate(documents):
            for length, n, shingles, starts, fingerprints in self.windows(words):
                kept.setdefault(length, []).append((d, n, shingles, starts, fingerprints))
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in documents]
        for length, parts in kept.items():
            index, ids, counters = self.lengths[length]
            owner = np.repeat(np.arange(len(parts)), [len(p[3]) for p in parts])
            starts = np.concatenate([p[3] for p in parts])
            windows, items = index.within(np.concatenate([p[4] for p in parts]))
            for w, i in zip(windows.tolist(), items.tolist(), strict=True):
                d, n, shingles, _, _ = parts[owner[w]]
                start = int(starts[w])
                similarity = self.alike(Counter(shingles[start:start + n].tolist()), counters[i])
                found = (-similarity, start, min(length, len(documents[d])))
                if similarity >= self.similarity and (ids[i] not in best[d] or found < best[d][ids[i]]):
                    best[d][ids[i]] = found
        return [[(item, start, n, -s) for item, (s, start, n) in sorted(one.items(), key=lambda found: (found[0] is None, found[0] or 0))]
                for one in best]


def item_slices(benchmark: DataFrame, item_id: str, item_text: str, slice_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items, in slices small enough to be sent to the workers."""
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where(
        "text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("n")).first()["n"]
    slices = max(1, math.ceil(size / (slice_words * 5)))
    for i in range(slices):
        # Items without id are dealt by their texts.
        rows = items.where(F.pmod(F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id")), F.lit(slices)) == i).collect()
        yield sorted(((r["id"], r["text"]) for r in rows), key=lambda item: (item[0] is None, item[0] or 0, item[1]))


def contaminated(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text",
                 text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS,
                 slice_words: int = SLICE_WORDS) -> DataFrame:
    """One row for each document and item found in it: ``docs`` without the text plus item_id, first_word, words, similarity."""
    return reduce(DataFrame.unionByName, [
        slice_matches(docs, items, text, width, similarity, radius)
        for items in item_slices(benchmark, item_id, item_text, slice_words)
    ])


def clean_documents(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text",
                    text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS,
                    slice_words: int = SLICE_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no item is found; one pass a slice, no shuffle."""
    for items in item_slices(benchmark, item_id, item_text, slice_words):
        docs = without_items(docs, items, text, width, similarity, radius)
    return docs


def without_items(docs: DataFrame, items: list[tuple[int, str]], text: str, width: int, similarity: float, radius: int) -> DataFrame:
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex  # at most a slice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = item_index(name, shared.value, width, similarity, radius)
        for batch in batches:
            clean = [not found for found in document_matches(index, batch.column(text).to_pylist())]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def document_matches(index: ItemIndex, texts: list[str | None]) -> Iterator[list[tuple[int, int, int, float]]]:
    for start, end in text_pieces(texts, PIECE_CHARS):
        codes, bounds = tokens().codes(texts[start:end])
        yield from index.matches([codes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])


def slice_matches(docs: DataFrame, items: list[tuple[int, str]], text: str, width: int, similarity: float, radius: int) -> DataFrame:
    added = T.StructType.fromDDL(MATCH)
    rest = [c for c in docs.columns if c != text and c not in added.names]
    docs = docs.select(*rest, text)
    schema = T.StructType([*[f for f in docs.schema if f.name in rest], *added])
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex  # at most a slice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = item_index(name, shared.value, width, similarity, radius)
        for batch in batches:
            rows: list[int] = []
            found: list[tuple[int, int, int, float]] = []
            for i, one in enumerate(document_matches(index, batch.column(text).to_pylist())):
                rows += [i] * len(one)
                found += one
            columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(at) for c in rest],
                 *[pa.array(v, pa.float64() if f.name == "similarity" else pa.int64()) for f, v in zip(added, columns, strict=True)]],
                names=schema.names)

    return docs.mapInArrow(run, schema)
