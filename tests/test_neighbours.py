"""The neighbour join against brute force, on clusters, copies and small blocks."""

import numpy as np
import pandas as pd
import pytest

from faultline.functions.vectors import similarity_score
from faultline.operators import neighbours
from faultline.operators.incidents import similar_incidents, text_similar_incidents
from faultline.operators.neighbours import _visits, build_index, nearest_incidents, search
from pyspark.sql import functions as F

SCHEMA = "id string, grp string, embedding array<float>"


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8)) * 4
    vectors = (centres[rng.integers(0, 6, n)] + rng.normal(size=(n, 8)) * 0.3).astype("float32")
    vectors[: n // 3] = vectors[0]  # a third of all rows are copies
    return [(f"i{i:04d}", "xyz"[i % 3], v.tolist()) for i, v in enumerate(vectors)]


def brute(probes, incidents, k, metric, grouped, exclude_self=True):
    out = set()
    for pid, pg, pv in probes:
        found = []
        for iid, ig, iv in incidents:
            if (exclude_self and iid == pid) or (grouped and ig != pg):
                continue
            a, b = np.float32(pv).astype(float), np.float32(iv).astype(float)
            if metric == "cosine":
                d = 1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
            else:
                d = ((a - b) ** 2).sum()
            found.append((round(d, 9), iid))
        out |= {(pid, iid, rank + 1) for rank, (d, iid) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("grouped", [False, True])
def test_against_brute_force(spark, metric, grouped):
    rows = clustered(120, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    got = nearest_incidents(
        df.withColumnRenamed("id", "probe_id"), df.withColumnRenamed("id", "incident_id"), 4,
        group="grp" if grouped else None, metric=metric, pivots=7, cell_rows=10, block_rows=16, chunk_rows=32, exclude_self=True)
    if metric == "l2":
        assert {(r.probe_id, r.incident_id, r.rank) for r in got.collect()} == brute(rows, rows, 4, metric, grouped)
    else:  # copies tie only up to rounding, so compare distances
        far = {}
        for r in got.collect():
            far.setdefault(r.probe_id, []).append((r.rank, r.distance))
        vectors = {r[0]: (r[1], np.float32(r[2]).astype(float)) for r in rows}
        for pid, ranked in far.items():
            pg, a = vectors[pid]
            want = sorted(1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
                          for iid, (g, b) in vectors.items() if iid != pid and (not grouped or g == pg))[:4]
            assert np.allclose([d for _, d in sorted(ranked)], want, atol=1e-9)


def test_other_probes_and_few_incidents(spark):
    incidents, probes = clustered(3, 1), [(f"p{i}", g, v) for i, g, v in clustered(10, 2)]
    got = nearest_incidents(
        spark.createDataFrame(probes, SCHEMA).withColumnRenamed("id", "probe_id"),
        spark.createDataFrame(incidents, SCHEMA).withColumnRenamed("id", "incident_id"), 5)
    assert {(r.probe_id, r.incident_id, r.rank) for r in got.collect()} == brute(probes, incidents, 5, "l2", False)


def test_no_incidents(spark):
    probes = spark.createDataFrame(clustered(4, 2), SCHEMA).withColumnRenamed("id", "probe_id")
    none = spark.createDataFrame([], SCHEMA).withColumnRenamed("id", "incident_id")
    found = similar_incidents(probes, none)
    assert found.count() == 0 and "similarity_score" in found.columns
    with pytest.raises(ValueError):
        nearest_incidents(probes, none, metric="other")


def test_similarity_score(spark):
    df = spark.createDataFrame([(0.25,), (-0.5,), (3.0,), (None,)], "d double")
    assert [r.s for r in df.select(similarity_score(F.col("d")).alias("s")).collect()] == [0.75, 1.0, 0.0, 0.5]


def test_equal_texts_are_nearest(spark):
    texts = ["disk full on node one", "token expired for user", "disk full on node one", "schema changed upstream"]
    df = spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(texts)], "id string, text string")
    got = text_similar_incidents(
        df.withColumnRenamed("id", "probe_id"), df.withColumnRenamed("id", "incident_id"), "text", k=1, exclude_self=True).collect()
    best = {r.probe_id: (r.incident_id, round(r.distance, 6)) for r in got}
    assert best["t0"] == ("t2", 0.0) and best["t2"] == ("t0", 0.0)


def test_many_groups_and_far_origin(spark):
    """Groups are a joined table, a large one beside many small ones; vectors far from zero keep their distances apart."""
    rng = np.random.default_rng(7)
    size = lambda g: 150 if g == 0 else 3
    rows = [(f"i{g:03d}_{j}", f"g{g:03d}", (1000 + rng.normal(size=5)).astype("float32").tolist()) for g in range(60) for j in range(size(g))]
    probes = [(f"p{g}_{j}", f"g{g:03d}", (1000 + rng.normal(size=5)).astype("float32").tolist()) for g in range(0, 62) for j in range(2)]
    probes.append(("none", None, probes[0][2]))
    incidents = spark.createDataFrame(rows + [("inull", None, rows[0][2])], SCHEMA).withColumnRenamed("id", "incident_id")
    index = build_index(incidents, group="grp", pivots=8, cell_rows=20, block_rows=11)
    assert index.blocks.where("n > 11").isEmpty() and index.groups.count() == 60 and len(index.pivots) == 8
    assert sorted({r["n"] for r in index.groups.selectExpr("size(cells) AS n").collect()})[-1] in range(4, 9)
    for _ in range(2):  # the index serves any number of searches
        got = search(index, spark.createDataFrame(probes, SCHEMA).withColumnRenamed("id", "probe_id"), 4, group="grp", chunk_rows=5)
        assert {(r.pid, r.iid, r["rank"]) for r in got.rows.collect()} == brute(probes, rows, 4, "l2", True)


def test_second_phase_visits_little_of_clustered_data(spark):
    """Distances computed for a probe, over both phases, are a small share of the history."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 6)) * 50
    vectors = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 6)) * 0.2
    df = spark.createDataFrame([(f"i{i:05d}", "", v.tolist()) for i, v in enumerate(vectors)], SCHEMA)
    index = build_index(df.withColumnRenamed("id", "incident_id"), pivots=64, cell_rows=64, block_rows=50)
    found = search(index, df.where("id LIKE '%7'").withColumnRenamed("id", "probe_id"), 5, exclude_self=True)
    work = {r.phase: (r.probes, r.distances) for r in found.work.collect()}
    assert work[1][0] == 600 and sum(d for _, d in work.values()) / 600 < 0.15 * 6000
    rows = [(r.id, "", r.embedding) for r in df.collect()]
    some = [r for r in rows if r[0].endswith("07")][:20]
    want = brute(some, rows, 5, "l2", False)
    names = {r[0] for r in some}
    assert {(r.pid, r.iid, r["rank"]) for r in found.rows.collect() if r.pid in names} == want


def test_a_vector_travels_by_shelf_not_by_block(spark):
    """Nothing can be pruned in noise, yet a probe is one row for each shelf, of which there are few however many blocks there are."""
    rows = [(f"i{i:04d}", "", v.tolist()) for i, v in enumerate(np.random.default_rng(11).normal(size=(1200, 16)))]
    df = spark.createDataFrame(rows, SCHEMA)
    index = build_index(df.withColumnRenamed("id", "incident_id"), pivots=64, cell_rows=16, block_rows=8)
    shelves = index.blocks.select("grp", "shelf").distinct().count()
    assert index.blocks.count() > 100 and shelves <= 17 and index.blocks.agg(F.sum("n")).first()[0] == 1200
    probes = df.withColumnRenamed("id", "pid").selectExpr("pid", "grp", "embedding AS pvec", "CAST('inf' AS DOUBLE) AS bound")
    visits = _visits(index, probes, lambda b: F.lit(True))
    assert visits.count() == 1200 * shelves
    assert visits.groupBy("pid").agg(F.sum("n").alias("n"), F.sum(F.size("blocks")).alias("b")).where(
        F.col("n") + F.col("b") != 1200 + index.blocks.count()).isEmpty()
    found = search(index, df.where("id LIKE '%5'").withColumnRenamed("id", "probe_id"), 5, exclude_self=True, chunk_rows=7)
    got = {(r.pid, r.iid, r["rank"]) for r in found.rows.collect()}
    assert got == brute([r for r in rows if r[0].endswith("5")], rows, 5, "l2", False)


def test_blocks_search_under_the_bound_of_earlier_ones(monkeypatch):
    """Few pairs are ranked exactly, and vectors that single precision cannot tell apart are still ranked right."""
    rng = np.random.default_rng(5)
    wide, close = rng.normal(size=(2000, 24)), np.r_[rng.normal(size=(3, 24)) * 900] .repeat(100, 0) + rng.normal(size=(300, 24)) * 1e-4
    pairs = []
    exact = neighbours._exact
    monkeypatch.setattr(neighbours, "_exact", lambda a, b, i, j: pairs.append(len(i)) or exact(a, b, i, j))
    for vectors, most in ((wide, 120), (close, 300), (np.r_[wide[:40], wide[:40]], 80)):
        left = pd.DataFrame({"pid": np.arange(len(vectors)), "pvec": list(vectors), "bound": np.inf,
                             "blocks": [np.arange(-(-len(vectors) // 20))] * len(vectors)})
        right = pd.DataFrame({"no": np.arange(len(vectors)) // 20, "iid": np.arange(len(vectors)), "ivec": list(vectors)})
        pairs.clear()
        got = neighbours._search(left, right.sample(frac=1, random_state=1), 5, False, True, tile=64)
        assert sum(pairs) / len(vectors) < most
        found = {}
        for p, i, d in zip(got["pid"], got["iid"], got["distance"]):
            found.setdefault(p, []).append((d, i))
        for p in range(0, len(vectors), 7):
            want = sorted((((vectors[p] - v) ** 2).sum(), i) for i, v in enumerate(vectors) if str(i) != str(p))[:5]
            assert [i for _, i in found[p]] == [i for _, i in want]
            assert [d for d, _ in found[p]] == pytest.approx([d for d, _ in want])
