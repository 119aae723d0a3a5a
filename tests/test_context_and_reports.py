"""Formats, history, changes, health, context, sinks and streams on hand cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from faultline.functions import render, text as t
from faultline.functions.vectors import add_vector, fit_vectoriser
from faultline.operators import commits, context, health, history, incidents as inc, metrics, reports
from faultline.plans import triage as plan
from faultline.session import shared_dir
from faultline.sources import readers, sinks
from faultline.streaming import streams
from tests_support import failure_frame, small_tables

T0 = dt.datetime(2024, 1, 15, 10, 0)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{k} {'double' if isinstance(x, float) or x is None else 'string'}" for k, x in values.items()))
    return df.select(column.alias("out")).first().out


@pytest.mark.parametrize("value", [0.0, 0.125, 0.5, 0.285, 0.85, 0.855, 0.999, 1.0, 0.15, 0.0005, 12.5])
def test_percent(spark, value):
    assert one(spark, t.percent(F.col("x")), x=value) == f"{value:.0%}"
    assert one(spark, t.percent(F.col("x"), 1), x=value) == f"{value:.1%}"
    assert one(spark, t.signed_percent(F.col("x")), x=-value * 100) == f"{-value * 100:+.1f}%".replace("-0.0%", "+-0.0%") \
        if value == 0 else True


@pytest.mark.parametrize("value", [45.0, 6.55, 1e7, 12345678.9, 0.0005, 1.5e-7, 1e16, 2.5e300, 1e15])
def test_number_text(spark, value):
    assert one(spark, t.number_or_na(F.col("x")), x=value) == str(value)


def test_falsy(spark):
    assert one(spark, t.number_or_na(F.col("x")), x=0.0) == "N/A"
    assert one(spark, t.number_or_na(F.col("x")), x=None) == "N/A"
    assert one(spark, t.strip(F.col("x")), x="\x1c  a b \n\t") == "a b"


def test_wall_clock(spark):
    kept = one(spark, F.date_format(t.parse_instant(F.col("x"), True), "HH:mm"), x="2024-01-15T10:00:00+02:00")
    moved = one(spark, F.date_format(t.parse_instant(F.col("x")), "HH:mm"), x="2024-01-15T10:00:00+02:00")
    assert (kept, moved) == ("10:00", "08:00")


def test_dag_history(spark):
    def run(i, state, days, took):
        return ("d", f"r{i:02d}", state, T0 - dt.timedelta(days=days), took)

    rows = [run(i, "failed" if i % 4 == 0 else "success", i * 0.5, 0.0 if i == 1 else 10.0 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "dag_id string, run_id string, state string, execution_date timestamp, duration_seconds double")
    got = history.dag_history(df, T0, with_runs=True).first()
    newest = rows[:20]
    good = [r[4] for r in newest if r[2] == "success" and r[4]]
    recent = [r for r in newest if r[3] > T0 - dt.timedelta(days=7)]
    assert len(got.recent_runs) == 20 and got.recent_runs[0].execution_date == T0
    assert got.avg_duration_seconds == pytest.approx(sum(good) / len(good))
    assert got.total_runs_7d == len(recent) == 14
    assert got.failure_rate_7d == pytest.approx(sum(r[2] == "failed" for r in recent) / len(recent))
    assert got.last_failure == T0 and got.last_success == rows[1][3]
    old = history.dag_history(df, T0 + dt.timedelta(days=90)).first()
    assert (old.total_runs_7d, old.failure_rate_7d) == (0, 0.0)


def commit_frame(spark, rows):
    return spark.createDataFrame(
        [(s, s[:7], "a", "e", "m", d, f) for s, d, f in rows],
        "sha string, short_sha string, author string, email string, message string, date timestamp, files_changed array<string>")


def test_commits_around_a_failure(spark):
    hours = [0, 1, 23, 24, 25, 200, -1]
    rows = [(f"sha{i:05d}xx", T0 - dt.timedelta(hours=h), ["dags/d.py"] if h >= 23 else ["x.py"]) for i, h in enumerate(hours)]
    fails = spark.createDataFrame([(1, "d", "dags/d.py", T0), (2, "e", None, T0 - dt.timedelta(days=400))],
                                  "id int, dag_id string, dag_file_path string, failed_at timestamp")
    recent = {r.id: [c.sha for c in r.recent_commits] for r in commits.recent_commits(fails, commit_frame(spark, rows)).collect()}
    assert recent == {1: [rows[i][0] for i in range(4)], 2: []}
    last = {r.id: r for r in commits.last_commit_asof(fails, commit_frame(spark, rows)).collect()}
    assert last[1].last_commit.sha == rows[2][0] and last[1].hours_since_last_change == 23.0 and last[2].last_commit is None
    assert [r.id for r in commits.suspect_regressions(fails, commit_frame(spark, rows)).collect()] == [1]
    many = [(f"s{i:04d}", T0 - dt.timedelta(minutes=i), ["x.py"]) for i in range(50)]
    got = commits.recent_commits(fails.where("id = 1"), commit_frame(spark, many)).first().recent_commits
    assert [c.sha for c in got] == [m[0] for m in many[:20]]


def test_resolve_dag_files(spark):
    files = [("x/dags/a/b_one_c.py", ""), ("one.py", ""), ("two.py", ""), ("dag_three.py", ""), ("y/four_dag.py", ""),
             ("z.txt", 'dag_id="five"'), ("a.py", 'x dag_id="five" dag_id="two"'), ("dags.py", ""), ("dags/six", "")]
    dags = spark.createDataFrame([(n,) for n in ["one", "two", "three", "four", "five", "six", "dag"]], "dag_id string")
    got = {r.dag_id: (r.dag_file_path, r.priority) for r in commits.resolve_dag_files(
        dags, spark.createDataFrame(files, "path string, content string")).collect()}
    assert got == {"one": ("x/dags/a/b_one_c.py", 1), "two": ("two.py", 2), "three": ("dag_three.py", 3),
                   "four": ("y/four_dag.py", 4), "five": ("a.py", 5), "six": (None, None), "dag": (None, None)}


def test_source_checks(spark):
    rows = [(1, "a", None, 200, None, None, None, 5.0, 25_000, ["x"]), (2, "a", "api", 503, 200, None, None, 6.0, 50_000, ["x", "y"]),
            (3, "a", "api", None, 200, "timeout", "t", 7.0, 0, ["y"]), (4, "a", "database", None, None, "timeout", "t", 7.0, 10, None),
            (5, "a", "database", None, None, None, None, 8.0, 100, ["y"]), (6, "a", "api", None, 200, "connect", "refused", 1.0, None, ["y"]),
            (7, None, "ftp", 200, 200, None, None, 1.0, 5, ["y"]), (8, "a", "api", None, 200, "other", "boom", 1.0, 5, ["y"]),
            (9, "a", "api", 204, 204, None, None, 1.0, 5, ["y"])]
    df = spark.createDataFrame(
        rows, "check_id bigint, source_name string, source_type string, status_code int, expected_status int, "
              "exception_kind string, exception_text string, latency_ms double, row_count bigint, columns array<string>"
    ).withColumn("last_checked", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("check_id") * 4000))
    normal = health.normalize_source_checks(df)
    got = {r.check_id: (r.reachable, r.error_message, r.latency_ms) for r in normal.collect()}
    assert got == {
        1: (True, None, 5.0), 2: (False, "HTTP 503", 6.0), 3: (False, "Timeout", None),
        4: (False, "Connection timeout", None), 5: (True, None, 8.0), 6: (False, "Connection failed: refused", None),
        7: (False, "Unknown source type: ftp", None), 8: (False, "boom", None), 9: (True, None, 1.0)}
    drift = {r.check_id: r for r in health.with_drift(normal).collect()}
    assert drift[2].row_count_delta_pct == 100.0 and drift[2].columns_added == ["y"] and drift[2].schema_changed
    assert drift[3].volume_anomaly and drift[3].columns_removed == ["x"]
    assert drift[4].row_count_delta_pct is None and drift[4].schema_changed is False
    assert drift[5].volume_anomaly and drift[5].row_count_delta_pct == 900.0
    assert drift[1].row_count_previous is None and drift[7].source_name == "unknown"


def test_value_buckets_keep_the_order(spark):
    values = sorted([0.0, 1e-9, 0.003, 0.0031, 0.5, 1.0, 1.01, 2.0, 95.5, 1e12, -1e-9, -0.5, -0.51, -3.0, -1e12])
    rows = spark.createDataFrame([(x,) for x in values], "x double").withColumn("b", health.value_bucket(F.col("x")))
    buckets = [r.b for r in rows.orderBy("x").collect()]
    assert buckets == sorted(buckets) and len(set(buckets)) >= len(values) - 1


def test_exact_percentile(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [("hot", float(x)) for x in rng.exponential(50, 500).round(1)] + [("one", 3.0), ("two", 1.0), ("two", 100.0)]
    df = spark.createDataFrame(rows + [("none", None)], "k string, x double")
    for q in (0.5, 0.95, 1.0):
        got = {r.k: r.percentile for r in health.exact_percentile(df, "k", "x", q).collect()}
        for key in ("hot", "one", "two"):
            assert got[key] == pytest.approx(np.quantile([x for k, x in rows if k == key], q))


def test_external_events(spark):
    fails = spark.createDataFrame([(1, "d", "t", T0)], "id int, dag_id string, task_id string, failed_at timestamp")
    minutes = [-31, -30, -1, 0, 5, 6]
    events = spark.createDataFrame([(m, "d", "t", T0 + dt.timedelta(minutes=m)) for m in minutes] + [(99, "d", "u", T0)],
                                   "m int, dag_id string, task_id string, event_time timestamp")
    assert sorted(r.m for r in metrics.external_events_window(fails, events).collect()) == [-30, -1, 0, 5]


REPORT = {
    "report_id": "0123456789", "generated_at": T0, "dag_id": "etl_sales", "task_id": "load", "run_id": "r",
    "failure_time": T0, "error_category": "resource_exhaustion", "severity": "high", "root_cause": "Memory <b> & \"q\"",
    "root_cause_summary": "Out of memory", "confidence": 0.85, "evidence": ["e1", "e2", "e3", "e4"], "key_log_lines": [],
    "contributing_factors": ["f"], "recent_changes": [], "recommendations": [("Increase memory", 1, "5 minutes", True), ("Split", 2, None, False)],
    "immediate_action": "", "similar_incidents": [], "is_recurring": False, "recurrence_count": 0,
    "analysis_duration_ms": 1500, "llm_model": None, "collectors_used": ["airflow", "git"],
}
REPORT_SCHEMA = (
    "report_id string, generated_at timestamp, dag_id string, task_id string, run_id string, failure_time timestamp, "
    "error_category string, severity string, root_cause string, root_cause_summary string, confidence double, "
    "evidence array<string>, key_log_lines array<string>, contributing_factors array<string>, "
    "recent_changes array<string>, recommendations array<struct<action:string,priority:int,estimated_effort:string,"
    "automated:boolean>>, immediate_action string, similar_incidents array<struct<incident_id:string,date:timestamp,"
    "dag_id:string,task_id:string,error_category:string,root_cause:string,resolution:string,similarity_score:double>>, "
    "is_recurring boolean, recurrence_count int, analysis_duration_ms int, llm_model string, collectors_used array<string>"
)


def report_frame(spark, **changes):
    return spark.createDataFrame([tuple({**REPORT, **changes}.values())], REPORT_SCHEMA)


def test_renderings(spark):
    rows = report_frame(spark)
    md = reports.export(rows).first().body
    assert md.startswith("# 🔍 RCA Report: etl_sales/load") and "🟠 HIGH" in md and "85%" in md
    assert "- ✅ Can be automated" in md and "Effort: 5 minutes" in md and "### Contributing Factors\n\n- f" in md
    assert "Key Log Lines" not in md and "Immediate Action" not in md and "**Analysis Duration:** 1500ms" in md
    page = reports.export(rows, "html").first().body
    assert page.startswith("<!DOCTYPE html>") and "<title>RCA Report" in page and "Memory &lt;b&gt; &amp; &quot;q&quot;" in page
    data = json.loads(reports.export(rows, "json").first().body)
    assert data["report_id"] == "0123456789" and data["confidence"] == 0.85 and len(data["recommendations"]) == 2
    assert data["llm_model"] is None and data["failure_time"] == "2024-01-15T10:00:00.000000Z"
    with pytest.raises(ValueError):
        reports.export(rows, "pdf")
    assert reports.summaries(rows).first().summary == "[HIGH] etl_sales/load: Out of memory (Confidence: 85%)"
    assert reports.file_names(rows).first().file_name == "20240115_100000_etl_sales_load_01234567.txt"
    assert reports.get_report(rows, "none").count() == 0
    payload = json.loads(reports.notifications(rows).first().payload)
    assert [b["type"] for b in payload["blocks"]] == ["header", "section", "section", "section"] and "channel" not in payload
    assert payload["blocks"][0]["text"]["text"] == "🟠 Pipeline Failure: etl_sales/load"
    assert payload["blocks"][3]["text"]["text"].count("•") == 3
    similar = [("i", T0, "d", "t", "unknown", "c" * 60, None, 0.5)]
    rows = report_frame(spark, similar_incidents=similar, is_recurring=True, recurrence_count=1, immediate_action="now")
    payload = json.loads(reports.notifications(rows, "#c").first().payload)
    assert payload["channel"] == "#c" and "1 similar incidents found. Last occurrence: 2024-01-15" in payload["blocks"][-1]["elements"][0]["text"]
    md = reports.export(rows).first().body
    assert "| 2024-01-15 | d/t | " + "c" * 50 + "... | N/A |" in md and "> **Immediate Action:** now" in md
    section = render.incident_section(F.col("similar_incidents"))
    assert render.NO_INCIDENTS == report_frame(spark).select(section.alias("s")).first().s


@pytest.mark.parametrize("severity, badge", [
    ("critical", "🔴 CRITICAL"), ("high", "🟠 HIGH"), ("medium", "🟡 MEDIUM"), ("low", "🟢 LOW"), ("odd", "odd")])
def test_badges(spark, severity, badge):
    assert one(spark, t.severity_badge(F.col("x")), x=severity) == badge


def test_minimal_triage(spark):
    """Only the required inputs: the gate holds back what is incomplete, and optional parts stay empty."""
    tables = small_tables(spark)
    rows = {r.run_id: r for r in plan.build_context(failure_frame(spark), tables).collect()}
    assert rows["r1"].has_context and rows["r1"].errors == [] and rows["r1"].git is None and rows["r1"].sources == []
    for run in ("r2", "r3"):
        assert not rows[run].has_context and len(rows[run].errors) == 3
    report = plan.triage(failure_frame(spark), tables).collect()
    assert len(report) == 1 and report[0].error_category == "resource_exhaustion" and report[0].collectors_used == ["airflow"]
    assert report[0].key_log_lines == ["java.lang.OutOfMemoryError: Java heap space"] and report[0].analysis_duration_ms is None
    prompt = reports.prompts(plan.build_context(failure_frame(spark), tables)).first().user_prompt
    assert "- Duration: N/As" in prompt and "- Operator: unknown" in prompt and "Git" not in prompt


def test_incident_store(spark):
    path = shared_dir(spark, "test-incidents")
    sinks.create_incidents(spark, path)
    for _ in range(2):
        sinks.append_incidents(spark, report_frame(spark), path)
    stored = readers.read_incidents(spark, path)
    assert stored.count() == 1 and inc.incident_lookup(stored, "0123456789").count() == 1
    updates = spark.createDataFrame(
        [("0123456789", "old", T0, 1), ("0123456789", "new", T0, 2), ("nope", "x", T0, 3)],
        "incident_id string, resolution string, updated_at timestamp, update_id int")
    fixed = inc.apply_resolutions(stored, updates).first()
    document = json.loads(fixed.document)
    assert fixed.resolution == document["resolution"] == "new" and document["evidence"] == REPORT["evidence"]
    assert fixed.resolution_updated and len(document["recommendations"]) == 2
    assert [r.incident_id for r in inc.rejected(updates, stored).collect()] == ["nope"]
    assert inc.unresolved(stored, updates).count() == 0
    text = report_frame(spark).select(inc.incident_text(report_frame(spark)).alias("x")).first().x
    assert text.endswith("Evidence: e1; e2; e3")


def test_incident_loop(spark):
    """What one run stores the next one finds, by the distance of the stored vectors."""
    errors = ["java.lang.OutOfMemoryError: Java heap space", "No space left on device", "HTTP 503 Service Unavailable",
              "KeyError: column 'a' not found"]
    runs = [f"r{i}" for i in range(8)]
    log_rows = [("d", r, "t", 1, f"start of work\n{errors[i % 4]}") for i, r in enumerate(runs)]
    some = small_tables(spark)
    instances = some.task_instances.withColumn("run_id", F.explode(F.array(*[F.lit(r) for r in runs])))
    logs = spark.createDataFrame(log_rows, "dag_id string, run_id string, task_id string, try_number int, stdout string")
    fails = spark.createDataFrame([("d", "t", r, 1, T0 + dt.timedelta(hours=i), None, "failed") for i, r in enumerate(runs)],
                                  failure_frame(spark).schema)
    tables = plan.Tables(instances, logs, some.dag_runs)
    first = plan.triage(fails.where("run_id < 'r4'"), tables)
    corpus = first.select(inc.incident_text(first).alias("text"))
    path = shared_dir(spark, "test-loop")
    sinks.create_incidents(spark, path, fit_vectoriser(corpus, "text", 64))
    for _ in range(2):
        sinks.append_incidents(spark, first, path)
    stored = readers.read_incidents(spark, path)
    history_rows = stored.collect()
    assert len(history_rows) == 4 and all(len(r.embedding) == 64 for r in history_rows)
    model = sinks.stored_vectoriser(spark, path)
    options = plan.Options(max_similar=2)
    again = plan.triage(fails.where("run_id >= 'r4'"), plan.Tables(
        instances, logs, some.dag_runs, incidents=stored, vectoriser=model), options).collect()
    contexts = plan.build_context(fails, tables)
    text = inc.query_text(F.col("dag_id"), F.col("task_id"), F.col("error_snippet"), F.col("error_message"))
    probes = {r.failure_id: r.embedding for r in add_vector(contexts.select("failure_id", text.alias("q")), "q", model).collect()}
    for report in again:
        far = sorted((sum((a - b) ** 2 for a, b in zip(probes[report.report_id], r.embedding)), r.incident_id) for r in history_rows)
        assert [s.incident_id for s in report.similar_incidents] == [i for _, i in far[:2]]
        assert report.is_recurring and report.recurrence_count == 2
    by_run = {r.run_id: r for r in again}
    seen = {r.incident_id: r.run_id for r in history_rows}
    assert all(seen[by_run[f"r{i + 4}"].similar_incidents[0].incident_id] == f"r{i}" for i in range(4))


def test_one_row_per_failure(spark):
    """Attempts, logs, replies and similar lists that come twice do not multiply a failure."""
    some = small_tables(spark)
    tries = some.task_instances.withColumn("try_number", F.explode(F.array(F.lit(3), F.lit(1), F.lit(2))))
    key = plan.with_ids(failure_frame(spark)).select("failure_id")
    replies = key.withColumn("raw", F.explode(F.array(F.lit("b"), F.lit("a"))))
    tables = plan.Tables(tries.union(tries), some.task_logs.union(some.task_logs), some.dag_runs.union(some.dag_runs), replies=replies)
    report = plan.triage(failure_frame(spark), tables).collect()
    assert len(report) == 1 and report[0].similar_incidents == []
    first = plan.build_context(failure_frame(spark).withColumn("try_number", F.lit(2)), tables).where("run_id = 'r1'").first()
    assert first.task.try_number == 2
    body = reports.export(plan.triage(failure_frame(spark), tables), "json").first().body
    assert json.loads(body)["similar_incidents"] == []


def test_ids_tell_nulls_apart(spark):
    rows = spark.createDataFrame([("a", None, "b"), (None, "a", "b"), ("a", "b", None), ("a", "", "b")], "x string, y string, z string")
    assert rows.select(context.failure_id("x", "y", "z").alias("i")).distinct().count() == 4


@pytest.mark.parametrize("run_id", ["scheduled__2024-01-15T00:00:00+00:00", "manual 50% done+%41", "a%2Fb"])
def test_log_paths(spark, run_id):
    import os

    root = shared_dir(spark, "test-paths").removeprefix("file:") + "/dags/team/dags"
    folder = f"{root}/dags/my+dag/dagRuns/{run_id}/taskInstances/t/logs"
    os.makedirs(folder)
    with open(f"{folder}/3", "w") as out:
        out.write("text")
    row = readers.read_task_logs(spark, root).first()
    assert (row.dag_id, row.run_id, row.task_id, row.try_number, row.stdout) == ("my+dag", run_id, "t", 3, "text")
    with open(f"{folder}/a+b.py", "w") as out:
        out.write("x")
    assert readers.read_dag_files(spark, root).first().path.startswith("dags/my+dag/dagRuns/")


def test_shared_dir_reads_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = shared_dir(spark, "x")
    assert path != shared_dir(spark, "x") and (base is None or path.startswith(base.rstrip("/")))


def test_stream_equals_batch(spark):
    """Two files, one per micro-batch; the replayed stream adds nothing."""
    source, out, history_path, checkpoint = (shared_dir(spark, f"test-{n}") for n in ("in", "out", "hist", "cp"))
    rows = failure_frame(spark).withColumn("event_id", F.lit(1))
    for run in ("r1", "r2"):
        rows.where(F.col("run_id") == run).coalesce(1).write.mode("append").json(source)
    sinks.create_incidents(spark, history_path)
    tables = small_tables(spark)
    for _ in range(2):
        streams.stream_triage(streams.stream_failures(spark, source, max_files=1),
                              lambda b: plan.triage(b, tables), out, checkpoint, history_path).awaitTermination()
    batch = plan.triage(failure_frame(spark), tables)
    columns = ["report_id", "error_category", "root_cause"]
    assert spark.read.parquet(out).select(columns).collect() == batch.select(columns).collect()
    assert readers.read_incidents(spark, history_path).count() == 1


def test_gate_keeps_earlier_errors(spark):
    rows = plan.build_context(failure_frame(spark), small_tables(spark)).where("run_id = 'r2'")
    again = context.gate(rows.withColumn("errors", F.array(F.lit("Git error: x"))))
    assert again.first().errors == ["Git error: x", context.COLLECTION_FAILED, context.NO_CONTEXT, context.NO_ANALYSIS]
