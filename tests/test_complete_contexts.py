"""Work that incomplete failures and repeated readings would add."""

import pytest
from pyspark.sql import functions as F

from checks import registry_io, registry_reports  # noqa: F401
from checks.registry import REGISTRY
from faultline.operators import commits, reports
from faultline.plans import triage as plan
from tests_support import T0, failure_frame, small_tables

COMMITS = ("sha string, short_sha string, author string, email string, message string, date timestamp, files_changed array<string>")


def tables(spark, **extra):
    made = spark.createDataFrame([("abc", "a", "me", "e", "m", T0, ["dags/d.py"])], COMMITS)
    return small_tables(spark, commits=made, **extra)


def test_only_complete_failures_are_joined_for_reports(spark, monkeypatch):
    seen = []
    last = commits.last_commit_asof
    monkeypatch.setattr(commits, "last_commit_asof", lambda rows, *a: seen.append(rows.count()) or last(rows, *a))
    failures = failure_frame(spark).withColumn("dag_file_path", F.lit("dags/d.py"))
    twice = failures.unionByName(failures.where("run_id = 'r1'"))
    whole = plan.build_context(twice, tables(spark))
    complete = plan.build_context(twice, tables(spark), complete_only=True)
    assert complete.columns == whole.columns and whole.count() == 4
    assert complete.collect() == whole.where("has_context").collect() and complete.count() == 2
    assert [r.run_id for r in plan.triage(twice, tables(spark)).collect()] == ["r1", "r1"]
    assert seen == [4, 2, 2]


def test_a_log_without_text_is_not_complete(spark):
    some = tables(spark)
    empty = plan.Tables(some.task_instances, some.task_logs.withColumn("stdout", F.lit(None).cast("string")), some.dag_runs)
    rows = plan.build_context(failure_frame(spark), empty)
    assert rows.count() == 3 and rows.where("has_context").isEmpty()
    assert plan.build_context(failure_frame(spark), empty, complete_only=True).isEmpty()


def test_the_search_writes_no_contexts(spark, monkeypatch):
    purposes = []
    settled = plan.settled
    monkeypatch.setattr(plan, "settled", lambda df, purpose: purposes.append((purpose, df.columns)) or settled(df, purpose))
    history = spark.createDataFrame(
        [("i1", "d", "t", "r0", "unknown", "low", 0.5, T0, "c", None, None, [1.0] * 16)],
        "incident_id string, dag_id string, task_id string, run_id string, error_category string, severity string, confidence double, "
        "date timestamp, root_cause_summary string, document string, resolution string, embedding array<float>")
    rows = plan.build_context(
        failure_frame(spark), tables(spark, incidents=history, vectoriser=registry_reports.LetterCounts()))
    assert [[s.incident_id for s in r.similar_incidents] for r in rows.collect()] == [["i1"]] * 3
    assert "contexts" not in [p for p, _ in purposes] and not any("git" in columns for _, columns in purposes)


@pytest.mark.parametrize("name", ["get_report", "export_formats"])
def test_reports_are_made_once(spark, monkeypatch, name):
    plans = []
    export = reports.export
    monkeypatch.setattr(reports, "export", lambda rows, fmt="markdown": plans.append(
        rows._jdf.queryExecution().optimizedPlan().toString()) or export(rows, fmt))
    assert REGISTRY[name][0](spark, "/root/testdata/sf0.001").count() > 0
    assert plans and not any("Join" in p for p in plans)
