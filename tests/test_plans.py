"""Shapes of physical plans that matter at scale."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import registry, views as v
from faultline.operators import commits, history, logs, metrics
from faultline.plans import triage as plan

SF = "/root/testdata/sf0.001"


def text_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_classification_does_not_shuffle(spark):
    rows = spark.read.schema(v.SCHEMAS["documents"]).parquet(f"{SF}/documents.parquet")
    plan_text = text_of(plan.classify_logs(rows.select("doc_id", F.col("text").alias("stdout"))))
    assert "Exchange" not in plan_text
    assert "EvalPython" not in plan_text and "InPandas" not in plan_text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan_text


def test_top_n_is_cut_before_the_shuffle(spark):
    for df in (history.newest_runs(v.runs(spark, SF)), commits.file_commits(v.commits(spark, SF)),
               logs.line_key_lines(v.log_lines(spark, SF), ["doc_id"])):
        assert text_of(df).count("WindowGroupLimit") >= 2


def test_filters_reach_the_scan(spark):
    plan_text = text_of(v.failures(spark, SF))
    assert "EqualTo(event_type,error)" in plan_text and "props" not in plan_text.split("ReadSchema")[1].split("\n")[0]


def test_time_lines_are_partitioned_by_part(spark):
    fails, runs = v.failures(spark, SF), v.runs(spark, SF)
    for df in (metrics.metrics_asof(fails, v.metrics(spark, SF)), commits.last_commit_asof(
            fails.withColumn("dag_file_path", F.lit("dags/dag_1.py")), v.commits(spark, SF)),
               history.previous_failure(runs), history.rolling_failure_rate(runs), history.numbered_runs(runs)):
        plan_text = text_of(df)
        assert "SinglePartition" not in plan_text
        assert "_part" in plan_text


@pytest.mark.parametrize("name", [
    "match_signatures", "dag_history", "rolling_failure_rate_7d", "recent_commits", "last_commit_asof",
    "resolve_dag_files", "source_health_asof", "metrics_asof", "external_events_window", "apply_resolutions",
    "recurrence_30d", "similar_incidents",
])
def test_no_cross_joins(spark, name):
    plan_text = text_of(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan_text and "BroadcastNestedLoopJoin" not in plan_text


def test_filter_on_a_verdict_does_not_repeat_it(spark):
    rows = logs.match_logs(v.plain_logs(spark, SF)).where(F.size("matches") > 0)
    assert text_of(rows).count("sig_idx") < 200


def test_every_query_has_a_unique_name_and_sql():
    without = {name for name, (_, sql) in registry.REGISTRY.items() if sql is None}
    assert without == {"text_similar_incidents"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "doc_id" and df.count() == 200


def test_triage_profiles_only_the_failures_logs(spark):
    """The classification sits above a semi-join that knows the failures' keys."""
    fails, logs_read = v.failures(spark, SF), v.task_logs(spark, SF)
    tables = plan.Tables(v.task_instances(spark, SF), logs_read, v.runs(spark, SF))
    optimized = plan.build_context(fails, tables)._jdf.queryExecution().optimizedPlan().toString()
    profile = optimized[optimized.index("sig_idx"):] if "sig_idx" in optimized else optimized
    assert "LeftSemi" in profile
