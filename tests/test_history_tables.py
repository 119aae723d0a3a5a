"""Tables kept over time: the incident history by day, its vectors' versions, daily sketches."""

import datetime as dt
import io
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from checks.registry_io import letter_model
from faultline.operators import sketches
from faultline.schemas import INCIDENT
from faultline.session import shared_dir
from faultline.sources import readers, sinks
from test_context_and_reports import report_frame

T0 = dt.datetime(2024, 1, 15, 10, 0)


def stored_days(spark, path, days):
    history = spark.range(days).select(
        F.concat(F.lit("old"), F.col("id").cast("string")).alias("incident_id"),
        F.timestamp_add("DAY", -F.col("id").cast("int"), F.lit(T0)).alias("date"))
    sinks.write_by_day(history, path, "append")


def test_append_reads_only_the_days_of_the_batch(spark):
    path = shared_dir(spark, "test-days")
    sinks.create_incidents(spark, path)
    stored_days(spark, path, 60)
    ids = readers.stored_ids(spark, path, [T0.date()])
    opened = {r.f for r in ids.select(F.input_file_name().alias("f")).distinct().collect()}
    assert {f.split("day=")[1][:10] for f in opened} == {"2024-01-15"} and len(spark.read.parquet(path).inputFiles()) >= 60
    text = io.StringIO()
    with redirect_stdout(text):
        ids.explain("formatted")
    assert "PartitionFilters: [isnotnull(day" in text.getvalue() and "ReadSchema: struct<incident_id:string>" in text.getvalue()
    assert [r.incident_id for r in ids.collect()] == ["old0"]
    report = report_frame(spark)
    days = [r.d for r in report.select(F.to_date("failure_time").alias("d")).distinct().collect()]
    for _ in range(2):
        sinks.append_incidents(spark, report, path)
        assert readers.read_incidents(spark, path).count() == 61 and readers.stored_ids(spark, path, days).count() >= 1
    assert readers.stored_ids(spark, path, []).count() == 0 and readers.stored_ids(spark, path, [None]).count() == 0


def test_resolutions_rewrite_only_their_days(spark):
    path = shared_dir(spark, "test-upsert")
    sinks.create_incidents(spark, path)
    stored_days(spark, path, 12)
    sinks.write_by_day(spark.createDataFrame([("undated",)], "incident_id string"), path, "append")
    files = lambda: set(spark.read.parquet(path).inputFiles())
    before = files()
    schema = "incident_id string, resolution string, updated_at timestamp, update_id int"
    updates = spark.createDataFrame([("old3", "first", T0, 1), ("old3", "last", T0, 2), ("undated", "x", T0, 3), ("nope", "y", T0, 4)], schema)
    for _ in range(2):
        sinks.upsert_resolutions(spark, path, updates)
        spark.catalog.refreshByPath(path)
        rows = {r.incident_id: r.resolution for r in readers.read_incidents(spark, path).collect()}
        assert len(rows) == 13 and {i: r for i, r in rows.items() if r} == {"old3": "last", "undated": "x"}
    changed = before ^ files()
    assert changed and all("day=2024-01-12" in f or "HIVE_DEFAULT" in f for f in changed)
    kept = files()
    broken = updates.withColumn("resolution", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        sinks.upsert_resolutions(spark, path, broken)
    sinks.upsert_resolutions(spark, path, updates.where("incident_id = 'nope'"))
    assert files() == kept


def test_incidents_without_a_time_are_kept_once(spark):
    path = shared_dir(spark, "test-no-time")
    sinks.create_incidents(spark, path)
    report = report_frame(spark).withColumn("failure_time", F.lit(None).cast("timestamp"))
    for _ in range(2):
        sinks.append_incidents(spark, report, path)
    stored = readers.read_incidents(spark, path)
    assert stored.count() == 1 and stored.columns == [c.split(" ")[0] for c in INCIDENT.split(", ")]


def test_only_stale_vectors_are_made_again(spark):
    old, new, newest = (shared_dir(spark, f"test-vectors-{i}") for i in range(3))
    first, second = letter_model("abc"), letter_model("xyz")
    sinks.create_incidents(spark, old, first)
    sinks.append_incidents(spark, report_frame(spark), old)
    one = readers.read_incidents(spark, old).first()
    assert len(one.embedding) == 3 and one.vector_version == first.uid and one.embedding[0] == one.text.count("a")
    # A row of the new version, marked, shows that it is copied and not made again; one without text loses its vector.
    marked = readers.read_incidents(spark, old).select(
        *[c for c in INCIDENT_COLUMNS if c not in ("incident_id", "embedding", "vector_version")], F.lit("marked").alias("incident_id"),
        F.array(F.lit(9.0), F.lit(9.0), F.lit(9.0)).cast("array<float>").alias("embedding"), F.lit(second.uid).alias("vector_version"))
    bare = marked.withColumns({"incident_id": F.lit("bare"), "text": F.lit(None).cast("string"), "vector_version": F.lit("other")})
    sinks.write_by_day(marked.unionByName(bare), old, "append")
    sinks.refresh_vectors(spark, old, new, second)
    rows = {r.incident_id: r for r in readers.read_incidents(spark, new).collect()}
    assert rows["marked"].embedding == [9.0] * 3 and rows["bare"].embedding is None and rows["bare"].vector_version is None
    assert rows[one.incident_id].embedding == [one.text.count(x) for x in "xyz"] and rows[one.incident_id].vector_version == second.uid
    model = sinks.stored_vectoriser(spark, new)
    assert model.uid == second.uid
    sinks.refresh_vectors(spark, new, newest, model)
    assert {r.incident_id: r.embedding for r in readers.read_incidents(spark, newest).collect()} == {i: r.embedding for i, r in rows.items()}


INCIDENT_COLUMNS = [c.split(" ")[0] for c in INCIDENT.split(", ")]


def test_daily_sketches_merge(spark):
    draw = random.Random(1)
    rows = [(f"s{i % 3}", T0 - dt.timedelta(days=draw.randint(0, 20)), draw.random() < 0.7,
             None if draw.random() < 0.1 else draw.expovariate(0.01)) for i in range(20_000)]
    rows += [("none", T0, True, None), ("s0", None, True, 1.0)]
    checks = spark.createDataFrame(rows, "source_name string, last_checked timestamp, reachable boolean, latency_ms double")
    path = shared_dir(spark, "test-sketches")
    daily = sketches.daily_source_checks(checks)
    sketches.write_daily(daily, path)
    before = set(spark.read.parquet(path).inputFiles())
    again = daily.where(F.col("day") == F.lit(T0.date()))
    sketches.write_daily(again, path)
    after = set(spark.read.parquet(path).inputFiles())
    assert all("day=2024-01-15" in f for f in before ^ after) and before & after
    table = spark.read.schema(daily.schema).parquet(path)
    since, until = (T0 - dt.timedelta(days=9)).date(), T0.date()
    got = {r.source_name: r for r in sketches.source_summary_period(table, F.lit(since), F.lit(until)).collect()}
    for name in ("s0", "s1", "s2"):
        mine = [r for r in rows if r[0] == name and r[1] and since <= r[1].date() <= until]
        times = sorted(r[3] for r in mine if r[3] is not None)
        r = got[name]
        assert r.checks == len(mine) and abs(r.reachable_share - sum(x[2] for x in mine) / len(mine)) < 1e-12
        assert abs(r.latency_mean - sum(times) / len(times)) < 1e-9
        for q, estimate in ((0.5, r.latency_p50), (0.95, r.latency_p95)):
            assert abs(sum(t <= estimate for t in times) / len(times) - q) <= 0.006
    assert (got["none"].checks, got["none"].latency_mean, got["none"].latency_p95) == (1, None, None)
