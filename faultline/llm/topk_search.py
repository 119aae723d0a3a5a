"""Exact top-k by inner product with multi-resolution segment statistics.

A vector cut into segments has, at each resolution, the mean of every segment and the norm of the deviations from it.
With ``n`` components a segment, ``sum(n * (mq - mx)**2 + (dq - dx)**2)`` is a lower bound of the squared distance of two
vectors (Cauchy-Schwarz on the deviations), and as ``2 q.x = |q|**2 + |x|**2 - distance**2`` the same statistics give the
upper bound ``sum(n * mq * mx + dq * dx)`` of the inner product.  Pairs are tried from one segment to many; those
whose bound is under the query's k-th best so far are dropped, the survivors get the exact product.

Candidates are dealt into blocks by the hash of their id and queries into chunks; each (block, chunk) is one
group of bounded size that returns at most k rows a query.  Both numbers follow from the counts, so no group grows with
the input.

Defined results: vectors that are null or hold a null or non-finite component, and rows with a null id, take no part; of
rows that repeat an id the least vector counts; only vectors of equal length are compared; equal scores go to the smaller
id; a query with fewer than k candidates gets them all; products are taken in 64-bit integers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

BLOCK_ROWS, CHUNK_ROWS, LEAST_BLOCKS, STEP_ROWS = 16_384, 2_048, 64, 2_048
RESULT = "query_id long, vec_id long, score long"


def quantized(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null if any is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint")))


def top_k_search(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 10, scale: int = 1024,
                 block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row for which ``is_query`` (over ``id``) holds."""
    clean = settled(
        vectors.select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vector_col), scale).alias("v"))
        .where("id IS NOT NULL AND v IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"))
        .withColumn("q", F.coalesce(is_query, F.lit(False))),
        "vectors",
    )
    counts = clean.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    blocks = max(LEAST_BLOCKS, math.ceil(counts["n"] / block_rows))
    chunks = max(1, math.ceil(counts["q"] / chunk_rows))
    of = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = clean.where("q").select("id", "v", of(chunks, 1).alias("chunk"), every(blocks).alias("block"))
    candidates = clean.select("id", "v", of(blocks, 2).alias("block"), every(chunks).alias("chunk"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return block_top(left["id"], left["v"], right["id"], right["v"], k)

    found = queries.groupBy("block", "chunk").cogroup(candidates.groupBy("block", "chunk")).applyInPandas(search, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def block_top(query_ids, query_vectors, ids, vectors, k: int) -> pd.DataFrame:
    """The k best candidates of one block for each query, among vectors of its length."""
    parts = []
    query_ids, ids = np.asarray(query_ids, np.int64), np.asarray(ids, np.int64)
    query_lengths = np.array([len(v) for v in query_vectors], np.int64)
    lengths = np.array([len(v) for v in vectors], np.int64)
    for n in np.unique(query_lengths):
        ql, cl = np.flatnonzero(query_lengths == n), np.flatnonzero(lengths == n)
        if not len(cl):
            continue
        order = cl[np.argsort(ids[cl], kind="stable")]
        q = np.array([query_vectors[i] for i in ql], np.int64).reshape(len(ql), n)
        x = np.array([vectors[i] for i in order], np.int64).reshape(len(order), n)
        rows, best_ids, scores = dense_top(query_ids[ql], q, ids[order], x, k)
        parts.append(pd.DataFrame({"query_id": query_ids[ql][rows], "vec_id": best_ids, "score": scores}))
    return pd.concat(parts) if parts else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})


def dense_top(query_ids, q, ids, x, k: int):
    """Rows (of queries), candidate ids and scores.  ``ids`` ascend."""
    n, floor = q.shape[1], np.iinfo(np.int64).min
    product = exact_product(q, x)
    q_stats, x_stats = segment_statistics(q), segment_statistics(x)
    slack = 1e-9 * (1 + np.sqrt((q.astype(float) ** 2).sum(1)))[:, None]
    x_norm = 1 + np.sqrt((x.astype(float) ** 2).sum(1))
    rows, top_ids, top = (np.zeros(0, np.int64) for _ in range(3))
    bar = np.full(len(q), floor, np.int64)
    for start in range(0, len(x), STEP_ROWS):
        part = slice(start, start + STEP_ROWS)
        alive = query_ids[:, None] != ids[None, part]
        known = bar > floor
        if n and known.any():
            for qs, xs in zip(q_stats, x_stats, strict=True):
                bound = qs @ xs[part].T + slack * x_norm[None, part]
                alive &= ~known[:, None] | (bound >= bar[:, None])
        r, c = np.nonzero(alive)
        if not len(r):
            continue
        score = product(r, c + start, len(alive) * alive.shape[1])
        rows, top_ids, top = best_rows(np.r_[rows, r], np.r_[top_ids, ids[part][c]], np.r_[top, score], k)
        full = np.bincount(rows, minlength=len(q)) >= k
        last = np.full(len(q), np.iinfo(np.int64).max)
        np.minimum.at(last, rows, top)
        bar = np.where(full, last, floor)
    return rows, top_ids, top


def best_rows(rows, ids, scores, k: int):
    """Of each row the k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, ~scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < k
    return rows[keep], ids[keep], scores[keep]


def segment_statistics(x) -> list[np.ndarray]:
    """For 1, 2, 4 ... segments: a row a vector whose products with another's are the bound of that resolution."""
    n, out, count = x.shape[1], [], 1
    while count < n:
        starts = np.linspace(0, n, count, endpoint=False).astype(int)
        sizes = np.diff(np.r_[starts, n])
        means = np.add.reduceat(x.astype(float), starts, axis=1) / sizes
        deviations = np.sqrt(np.add.reduceat((x - np.repeat(means, sizes, axis=1)) ** 2, starts, axis=1))
        out.append(np.hstack([means * np.sqrt(sizes), deviations]))
        count *= 4
    return out


def exact_product(q, x):
    """Exact integer products of chosen pairs.  Floating point is used only where every partial sum is exact in it."""
    n = q.shape[1]
    largest = [float(np.abs(m.astype(float)).max(initial=0.0)) for m in (q, x)]
    exact = largest[0] * largest[1] * max(n, 1) < 2.0**52
    qf, xf = (q.astype(float), x.astype(float)) if exact else (q, x)

    def pairs(r, c, cells: int):
        if exact and len(r) * 8 > cells:
            low, high = c.min(), c.max() + 1
            return (qf @ xf[low:high].T)[r, c - low].astype(np.int64)
        out = np.empty(len(r), np.int64)
        for s in range(0, len(r), 65_536):
            part = slice(s, s + 65_536)
            out[part] = np.einsum("ij,ij->i", qf[r[part]], xf[c[part]])
        return out

    return pairs
