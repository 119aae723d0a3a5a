"""Small helpers of the text operators."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import settled

__all__ = [
    "BoundedCache", "TokenCodes", "components", "fold_of", "held", "mixed", "settled", "shingle_codes", "table", "text_pieces",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of the id's text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


_HELD: dict = {}


def held(key: tuple, make: Callable):
    """What a worker remembers from task to task, of one operator at a time: the next operator's memory replaces it."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


class BoundedCache(dict):
    """A memo of a pure function that empties itself at ``limit`` entries, so a worker's memory stays bounded."""

    def __init__(self, function: Callable, limit: int):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.function(key)
        return value


def text_pieces(texts: list[str | None], most_chars: int):
    """Runs (start, end) of neighbouring texts of at most ``most_chars`` characters, or of one longer text."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and chars + n > most_chars:
            yield start, i
            start, chars = i, 0
        chars += n
    if start < len(texts):
        yield start, len(texts)


class TokenCodes:
    """Hashes of the tokens of texts as arrays.

    ``split`` cuts a blank-free, lower-cased chunk into tokens.  Chunks repeat, so each is cut and hashed once and then
    looked up, in a memory of at most about ``limit`` chunks.
    """

    def __init__(self, split: Callable[[str], list[str]], limit: int = 200_000):
        self.split, self.limit = split, limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.size, self.code = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def learn(self, chunks: set[str]) -> None:
        fresh = list(chunks.difference(self.known))
        if not fresh:
            return
        tokens = [self.split(c.lower()) for c in fresh]
        sizes = np.fromiter(map(len, tokens), np.int64, len(fresh))
        codes = np.fromiter((xxhash.xxh64_intdigest(t) for ts in tokens for t in ts), np.uint64, int(sizes.sum()))
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        self.first = np.r_[self.first, len(self.code) + np.cumsum(sizes) - sizes]
        self.size, self.code = np.r_[self.size, sizes], np.r_[self.code, codes]

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' codes end to end, and where each text's begin (one more entry than texts)."""
        chunks = [t.split() if t else [] for t in texts]
        if len(self.known) > self.limit:
            self.clear()
        self.learn(set().union(*chunks))
        total = sum(map(len, chunks))
        at = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(chunks)), np.int64, total)
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        places = np.repeat(self.first[at] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        bounds = np.cumsum([0, *map(len, chunks)], dtype=np.int64)
        return self.code[places], np.r_[0, ends][bounds]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_codes(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` neighbouring tokens; of all of them if there are fewer; none of none."""
    width = min(width, len(codes))
    if not width:
        return codes[:0]
    out = codes[:len(codes) - width + 1].copy()
    for i in range(1, width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + codes[i:len(codes) - width + 1 + i])
    return out


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """node, root: the least node of each connected component, for nodes of ``edges`` (a, b longs, a <> b).

    Large-star and small-star steps in turn: every node's neighbours are linked to its least neighbour.  Minima are combined in the map
    tasks, edges are joined by node (where a hub's side can be split), and each round is a written table.
    """
    edges = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), purpose)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        lower = large.where("a <> b").distinct()
        low = lower.groupBy("a").agg(F.min("b").alias("m"))
        small = lower.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(
            low.select("a", F.col("m").alias("b")))
        after = settled(small.distinct(), purpose)
        # Done when the edges are stars: every node has one lower neighbour, which has none.
        state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        before = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        edges = after
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
