"""Time lines against brute force, with a hot key that holds most rows, in one part and in many."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators.health import source_health_asof, sources_at
from faultline.operators.history import history_asof
from faultline.operators import timeline
from faultline.operators.timeline import Timeline, asof_join, rolling_counts, segmented_scan, with_previous

START = dt.datetime(2024, 1, 1)


def moments(rng, n, hours=72):
    return [START + dt.timedelta(seconds=rng.randint(0, hours * 3600)) for _ in range(n)]


def rows_of(seed, n):
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < 0.7 else rng.choice("abc"), t, rng.choice([None, rng.randint(0, 9)]))
            for i, t in enumerate(moments(rng, n))]


@pytest.mark.parametrize("parts", [None, 9])
@pytest.mark.parametrize("on", [["key"], []])
def test_asof_join(spark, on, parts):
    left, right = rows_of(1, 200), rows_of(2, 150)
    right.append((999, "hot", None, 5))
    schema = "id int, key string, at timestamp, value int"
    left_df = spark.createDataFrame(left, schema)
    right_df = spark.createDataFrame(right, schema).withColumnRenamed("id", "rid")
    if not on:
        right_df = right_df.drop("key")
    got = asof_join(left_df, [
        Timeline(right_df, "at", {"row": F.struct("rid", "value")}, ("rid",)),
        Timeline(right_df.withColumnRenamed("at", "at2"), "at2", {"newest_value": F.col("value")}, ("rid",)),
    ], on, "at", parts=parts)
    assert got.count() == len(left)
    for r in got.collect():
        before = sorted((x for x in right if x[2] and x[2] <= r.at and (not on or x[1] == r.key)), key=lambda x: (x[2], x[0]))
        assert (r.row.rid if r.row else None) == (before[-1][0] if before else None)
        known = [x[3] for x in before if x[3] is not None]
        assert r.newest_value == (known[-1] if known else None)


@pytest.mark.parametrize("parts", [1, 11])
@pytest.mark.parametrize("shape", ["spread", "one instant"])
def test_with_previous(spark, shape, parts):
    rows = rows_of(3, 300)
    if shape == "one instant":
        rows = [(i, "hot" if i % 9 else None, START, x) for i, _, _, x in rows]
    df = spark.createDataFrame(rows, "id int, key string, at timestamp, value int")
    got = with_previous(df, ["key"], "at", ["id"], {"prev": F.struct("id", "value"), "known": F.col("value")}, parts=parts)
    for r in got.collect():
        before = sorted((x for x in rows if x[1] == r.key and (x[2], x[0]) < (r.at, r.id)), key=lambda x: (x[2], x[0]))
        assert (tuple(r.prev) if r.prev else None) == ((before[-1][0], before[-1][3]) if before else None)
        known = [x[3] for x in before if x[3] is not None]
        assert r.known == (known[-1] if known else None)


@pytest.mark.parametrize("lower, upper", [(-6 * 3600, 0), (-30 * 3600 - 0.000001, -0.000001)])
@pytest.mark.parametrize("shape, parts", [("spread", None), ("spread", 10), ("one hour", 10), ("one instant", 10)])
def test_rolling_counts(spark, lower, upper, shape, parts):
    rows = rows_of(4, 300) + [(1000 + i, "hot", START + dt.timedelta(hours=6 * i), 1) for i in range(5)]
    if shape == "one hour":
        rows = [(i, "hot", START + dt.timedelta(seconds=11 * i), x) for i, _, _, x in rows[:200]]
    if shape == "one instant":
        rows = [(i, "hot", START, x) for i, _, _, x in rows]
    # Repeated rows count as often as they are there; a row without time counts nowhere.
    rows = rows + rows[:7] + [(2000, "hot", None, 3), (2001, None, START, 1), (2001, None, START, 1)]
    df = spark.createDataFrame(rows, "id int, key string, at timestamp, value int")
    low, high = round(lower * 1e6), round(upper * 1e6)
    got = rolling_counts(df, ["key"], "at", {"n": F.lit(1), "s": F.coalesce("value", F.lit(0))}, low, high, parts=parts)
    assert got.count() == len(rows)
    for r in got.collect():
        if r.at is None:
            assert r.n is None and r.s is None
            continue
        span = [x for x in rows if x[1] == r.key and x[2] is not None
                and dt.timedelta(microseconds=low) < x[2] - r.at <= dt.timedelta(microseconds=high)]
        assert (r.n, r.s) == (len(span), sum(x[3] or 0 for x in span))


def test_history_asof(spark):
    rng = random.Random(5)
    runs = [("d" + str(rng.randint(0, 2)), f"r{i:03}", rng.choice(["success", "failed", "running"]), t, rng.choice([None, 0.0, 5.0, 7.5]))
            for i, t in enumerate(moments(rng, 300, hours=24 * 30))]
    runs += [("d0", "r900", "failed", None, 1.0), (None, "r901", "failed", START, 1.0), runs[0]]
    fails = [(f"f{i}", f"d{i % 4}", t) for i, t in enumerate(moments(rng, 40, hours=24 * 30))] + [("f99", None, START), ("f98", "d0", None)]
    frame = spark.createDataFrame(fails, "failure_id string, dag_id string, failed_at timestamp")
    table = spark.createDataFrame(runs, "dag_id string, run_id string, state string, execution_date timestamp, duration_seconds double")
    got = {r.failure_id: r for r in history_asof(frame.union(frame.limit(3)), table, limit=6).collect()}
    for key, dag, at in fails:
        before = [r for r in runs if dag and at and r[0] == dag and r[3] and r[3] <= at]
        before.sort(key=lambda r: (r[3], r[1]), reverse=True)
        if not before:
            assert key not in got
            continue
        row, newest = got[key], before[:6]
        assert [(x.state, x.execution_date) for x in row.recent_runs] == [(r[2], r[3]) for r in newest]
        assert row.last_failure == max((r[3] for r in newest if r[2] == "failed"), default=None)
        assert row.last_success == max((r[3] for r in newest if r[2] == "success"), default=None)
        week = [r for r in before if r[3] > at - dt.timedelta(days=7)]
        assert row.total_runs_7d == len(week)
        assert row.failure_rate_7d == (sum(r[2] == "failed" for r in week) / len(week) if week else 0.0)


def test_six_hundred_sources(spark):
    checks = [(i, f"s{i % 600}", START + dt.timedelta(minutes=i)) for i in range(1500)]
    frame = spark.createDataFrame(checks, "check_id int, source_name string, last_checked timestamp")
    for name, kind in (("source_type", "string"), ("reachable", "boolean"), ("latency_ms", "double"), ("error_message", "string"),
                       ("row_count", "bigint"), ("row_count_previous", "bigint"), ("row_count_delta_pct", "double"), ("schema_changed", "boolean")):
        frame = frame.withColumn(name, F.lit(None).cast(kind))
    names = [f"s{i}" for i in range(600)]
    fails = spark.createDataFrame([(1, START + dt.timedelta(days=3)), (2, START + dt.timedelta(minutes=10)), (3, START - dt.timedelta(days=1))],
                                  "id int, failed_at timestamp")
    got = {r.id: [(s.source_name, s.last_checked) for s in r.sources] for r in source_health_asof(fails, frame, names).collect()}
    newest = {name: max(t for _, n, t in checks if n == name) for name in names}
    assert got == {1: [(n, newest[n]) for n in names], 2: [(f"s{i}", START + dt.timedelta(minutes=i)) for i in range(11)], 3: []}


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 40])
def test_sources_at_with_ties_and_unused_sources(spark, monkeypatch, n):
    """A failure meets the scan once for every 16 sources, not once for each."""
    rng = random.Random(n)
    checks = [(i, rng.choice([None, *(f"s{k}" for k in range(n + 2))]), START + dt.timedelta(minutes=rng.randint(0, 20)), float(i)) for i in range(300)]
    frame = spark.createDataFrame(checks, "check_id int, source_name string, last_checked timestamp, latency_ms double")
    for name, kind in (("source_type", "string"), ("reachable", "boolean"), ("error_message", "string"), ("row_count", "bigint"),
                       ("row_count_previous", "bigint"), ("row_count_delta_pct", "double"), ("schema_changed", "boolean")):
        frame = frame.withColumn(name, F.lit(None).cast(kind))
    names = [f"s{k}" for k in reversed(range(n))]
    asked = [(i, rng.choice([None, START + dt.timedelta(minutes=rng.randint(-2, 25))])) for i in range(60)] + [(5, START + dt.timedelta(minutes=30))]
    fails = spark.createDataFrame(asked, "id int, failed_at timestamp")
    scanned = []
    written = timeline.settled
    monkeypatch.setattr(timeline, "settled", lambda df, purpose: scanned.append(written(df, purpose)) or scanned[-1])
    got = {r.id: [(s.source_name, s.latency_ms) for s in r.sources] for r in sources_at(fails, frame, [*names, *names], "id").collect()}
    latest = {}
    for i, at in asked:
        latest[i] = max([t for t in (latest.get(i), at) if t is not None], default=None)
    want = {}
    for i, at in latest.items():
        seen = {name: max(((t, c) for c, s, t, _ in checks if s == name and at and t <= at), default=None) for name in names}
        if any(seen.values()):
            want[i] = [(name, float(seen[name][1])) for name in names if seen[name]]
    assert got == want
    assert sum(t.where("_kind = 1").count() for t in scanned) == 60 * -(-n // 16)


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("keys", [1, 3, 40])
def test_segmented_scan(spark, keys, inclusive):
    """Keys longer than a part, keys within one and null keys; some values null."""
    rng = random.Random(keys)
    rows = [(rng.choice([None, *range(keys)]), i // 7, i, rng.choice([None, None, rng.randint(0, 99)])) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key int, at int, id int, value int")
    got = segmented_scan(df, ["key"], ["at", "id"], {"newest": "value"}, {"total": "value"}, inclusive, parts=13).collect()
    assert sorted((r.id, r.key, r.at, r.value) for r in got) == sorted((i, k, a, v) for k, a, i, v in rows)
    for r in got:
        before = sorted(x[2:] for x in rows if x[0] == r.key and (x[2] <= r.id if inclusive else x[2] < r.id))
        known = [v for _, v in before if v is not None]
        assert (r.newest, r.total) == (known[-1] if known else None, sum(known))


@pytest.mark.parametrize("shape", ["one key", "one hour", "one instant"])
def test_parts_of_one_key_are_even(spark, monkeypatch, shape):
    """A key with all rows, in one hour or at one instant: no part has twice the median's rows."""
    written = []
    settled = timeline.settled
    monkeypatch.setattr(timeline, "settled", lambda df, name: written.append(settled(df, name)) or written[-1])
    seconds = {"one key": F.col("id") * 60, "one hour": F.col("id") % 3600, "one instant": F.lit(0)}[shape]
    rows = spark.range(40_000).select(F.lit("hot").alias("key"), "id", F.timestamp_seconds(seconds).alias("at"))
    out = with_previous(rows, ["key"], "at", ["id"], {"prev": F.col("id")}, parts=8)
    assert out.where("prev IS NOT NULL").count() == 39_999
    # 100 left rows see 40,000 right rows of the key, and the other way round.
    few = rows.where("id % 400 = 0")
    line = lambda r: Timeline(r, "at", {"seen": F.col("id")}, ("id",))
    assert asof_join(few, [line(rows)], ["key"], "at", parts=8).where("seen IS NOT NULL").count() == 100
    assert asof_join(rows, [line(few)], [], "at", parts=8).where("seen IS NOT NULL").count() == 40_000
    for table in written:
        sizes = sorted(r["count"] for r in table.groupBy("_part").count().collect())
        assert len(sizes) >= 7 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_rows_out_of_sight_are_reduced(spark, monkeypatch):
    """Rows before a key's first left row count as one, later ones and those of other keys are not scanned."""
    written = []
    settled = timeline.settled
    monkeypatch.setattr(timeline, "settled", lambda df, name: written.append(settled(df, name)) or written[-1])
    at = lambda days: START + dt.timedelta(days=days)
    right = [("a", at(i), i) for i in range(50)] + [("b", at(i), i) for i in range(50)]
    right_df = spark.createDataFrame(right, "key string, at timestamp, value int")
    left = spark.createDataFrame([("a", at(40)), ("a", at(42)), ("a", None), ("c", at(3))], "key string, at timestamp")
    got = asof_join(left, [Timeline(right_df, "at", {"value": F.col("value")})], ["key"], "at").collect()
    assert sorted((r.key, r.at, r.value) for r in got if r.at) == [("a", at(40), 40), ("a", at(42), 42), ("c", at(3), None)]
    assert [r.value for r in got if r.at is None] == [None]
    assert written[0].count() == 4 + 1 + 3


def test_last_rows_are_slices_of_blocks(spark):
    from faultline.operators.timeline import last_rows

    numbered = spark.range(1, 31).selectExpr("'a' AS k", "id AS n", "id * 10 AS value").union(
        spark.range(1, 3).selectExpr("'b' AS k", "id AS n", "id AS value"))
    asked = spark.createDataFrame([("a", i) for i in range(1, 31)] + [("a", None), ("b", 2), ("c", 1)], "k string, at bigint")
    got = {(r.k, r.at): r.newest for r in last_rows(asked, numbered, ["k"], "at", 3, "newest").collect()}
    assert got == {**{("a", i): [x * 10 for x in range(i, max(0, i - 3), -1)] for i in range(1, 31)},
                   ("a", None): None, ("b", 2): [2, 1], ("c", 1): None}


def test_lists_are_not_multiplied_by_the_limit(spark):
    """The join that made the lists exploded every number by the limit and was broadcast by the size before that."""
    from faultline.operators import commits, history

    rows = spark.range(200).selectExpr(
        "CAST(id AS string) AS failure_id", "'d' AS dag_id", "timestamp_seconds(id) AS failed_at")
    runs = spark.range(200).selectExpr("'d' AS dag_id", "CAST(id AS string) AS run_id", "'failed' AS state",
                                       "timestamp_seconds(id) AS execution_date", "1.0D AS duration_seconds")
    made = spark.range(200).selectExpr(
        "CAST(id AS string) AS sha", "'s' AS short_sha", "'a' AS author", "'e' AS email", "'m' AS message",
        "timestamp_seconds(id) AS date", "array('f') AS files_changed")
    found = commits.recent_commits(rows, made), history.history_asof(rows, runs)
    assert all("sequence(" not in f._jdf.queryExecution().optimizedPlan().toString() for f in found)
    assert {r.failure_id: [x.sha for x in r.recent_commits] for r in found[0].collect()}["150"] == [str(i) for i in range(150, 130, -1)]


def test_wide_parts_join_by_failure_id(spark):
    """Of an id that comes with two times each row keeps its own commits."""
    from faultline.operators import context

    rows = spark.sql("SELECT 'x' AS failure_id, timestamp_seconds(t) AS failed_at FROM VALUES (5), (50) AS v(t)")
    made = spark.range(0, 60, 10).selectExpr(
        "CAST(id AS string) AS sha", "'s' AS short_sha", "'a' AS author", "'e' AS email", "'m' AS message",
        "timestamp_seconds(id) AS date", "array('f') AS files_changed")
    got = context.join_recent_commits(rows, rows, made).collect()
    assert sorted([c.sha for c in r.recent_commits] for r in got) == [["0"], ["50", "40", "30", "20", "10", "0"]]
