"""Whitening against a dense computation of the same definitions in whole numbers."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from faultline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n int, z int, copies int"


def taken(rows, width):
    good = [(i, v) for i, v in rows if v and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in good]


def brute(rows, width, weight="count"):
    x = taken(rows, width)
    fit = [v for _, v in x] if weight == "count" else [list(v) for v in {tuple(v) for _, v in x}]
    n = len(fit)
    sums = [sum(col) for col in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in fit])
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    rows_out = []
    for i, v in x:
        d = [n * c - s for c, s in zip(v, sums)]
        rows_out.append((i, sum(c * c for c in d), np.array([c / n for c in d]) @ axes / np.sqrt(np.maximum(values, 1e-300))))
    return n, values / np.trace(covariance), rows_out


def sample_rows(n=300, width=6):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 0.2 + 0.3 * d) for d in range(width)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(2000 + i, rows[i % 7][1]) for i in range(50)] + [(5, rows[5][1])] * 3
    odd = [(None, rows[8][1]), (3000, None), (3001, []), (3002, [0.1] * (width - 1) + [None]), (3003, [math.nan] * width),
           (3004, [math.inf] + [0.0] * (width - 1)), (3005, [0.5] * (width + 2))]
    return rows + odd


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1, 2, 3) for i, v in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("weight, hot", [("count", 1000), ("one", 1000), ("count", 3)])
def test_whitening_equals_dense_computation(spark, weight, hot):
    rows = sample_rows()
    found = whitening.whiten(frame(spark, rows), components=4, weight=weight, hot=hot).collect()
    n, explained, expected = brute(rows, 6, weight)
    assert len(found) == 4 * len(expected)
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, []).append(r)
    signs = None
    for i, deviation, z in expected:
        got = sorted(by_id[i], key=lambda r: r.component)[::len(by_id[i]) // 4]
        assert [r.component for r in got] == [1, 2, 3, 4] and all(r.n == n and int(r.deviation) == deviation for r in got)
        values = np.array([r.whitened for r in got])
        if signs is None and min(abs(z[:4])) > 1e-3:
            signs = np.sign(values) * np.sign(z[:4])
        if signs is not None:
            assert np.allclose(values, signs * z[:4], rtol=0, atol=1e-9)
        assert np.allclose([r.explained for r in got], explained[:4], rtol=1e-10)
        assert all(0 <= r.identity_error < 1e-9 for r in got)
    assert signs is not None


def test_large_numbers_stay_exact(spark):
    rows = [(i, [1e30 if i % 2 else -1e30, 1e12 * i]) for i in range(40)]
    found = whitening.whiten(frame(spark, rows)).collect()
    bound = 1 << 52
    x = [[(bound if i % 2 else -bound) + 1_000_000, min(math.floor(64 * float(np.float32(1e12 * i))), bound) + 1_000_000]
         for i in range(40)]
    sums = [sum(c) for c in zip(*x)]
    assert {r.vec_id: int(r.deviation) for r in found} == {
        i: sum((40 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}


def test_no_variance_and_empty(spark):
    found = whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(found) == 4 and all(r.whitened is None and r.deviation == 0 and r.identity_error is None for r in found)
    flat = whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.75])])).collect()
    assert sorted((r.component, r.whitened is None) for r in flat) == [(1, False), (1, False), (2, True), (2, True)]
    none = whitening.whiten(frame(spark, [(1, None), (2, [])]))
    assert none.collect() == [] and none.columns[:2] == ["vec_id", "component"]
