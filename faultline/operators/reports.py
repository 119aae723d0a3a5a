"""Report rows and their renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions import render
from faultline.operators.context import collectors_used, failure_id

REPORT_COLUMNS = [
    "report_id", "generated_at", "dag_id", "task_id", "run_id", "failure_time", "error_category", "severity",
    "root_cause", "root_cause_summary", "confidence", "evidence", "key_log_lines", "contributing_factors",
    "recent_changes", "recommendations", "immediate_action", "similar_incidents", "is_recurring", "recurrence_count",
    "analysis_duration_ms", "llm_model", "collectors_used",
]

FORMATS = {
    "markdown": render.markdown,
    "html": render.html,
    "json": lambda: render.json_report(REPORT_COLUMNS),
}


def build_reports(analysed: DataFrame, model_name: str | None = None, generated_at: Column | None = None) -> DataFrame:
    """Context rows with ``verdict``, ``key_log_lines`` and ``similar_incidents`` to report rows.

    ``generated_at`` defaults to the failure time, which keeps a replay identical.  The duration is not measured per
    row in a set-wise run and stays null.
    """
    similar = F.size(F.coalesce(F.col("similar_incidents"), F.array()))
    commits = F.slice(F.coalesce(F.col("git.recent_commits"), F.array()), 1, 3)
    return analysed.select(
        failure_id("dag_id", "task_id", "run_id", "try_number").alias("report_id"),
        (F.col("failed_at") if generated_at is None else generated_at).alias("generated_at"),
        "dag_id", "task_id", "run_id", F.col("failed_at").alias("failure_time"),
        "verdict.error_category", "verdict.severity", "verdict.root_cause", "verdict.root_cause_summary",
        "verdict.confidence", "verdict.evidence", "key_log_lines", "verdict.contributing_factors",
        F.transform(commits, lambda k: F.concat(k["short_sha"], F.lit(": "), k["message"])).alias("recent_changes"),
        "verdict.recommendations", "verdict.immediate_action", "similar_incidents",
        (similar > 0).alias("is_recurring"), similar.alias("recurrence_count"),
        F.lit(None).cast("int").alias("analysis_duration_ms"),
        F.when(F.col("verdict_source") == "model", F.lit(model_name)).alias("llm_model")
        if model_name else F.lit(None).cast("string").alias("llm_model"),
        collectors_used().alias("collectors_used"),
    )


def export(reports: DataFrame, fmt: str = "markdown") -> DataFrame:
    """(report_id, body) in the given format."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    return reports.select("report_id", FORMATS[fmt]().alias("body"))


def get_report(reports: DataFrame, report_id: str, fmt: str = "json") -> DataFrame:
    return export(reports.where(F.col("report_id") == report_id), fmt)


def summaries(reports: DataFrame) -> DataFrame:
    return reports.select("report_id", render.summary().alias("summary"))


def file_names(reports: DataFrame) -> DataFrame:
    return reports.select("report_id", render.file_name().alias("file_name"))


def notifications(reports: DataFrame, channel: str | None = None) -> DataFrame:
    return reports.select("report_id", render.chat_payload(channel).alias("payload"))


def prompts(contexts: DataFrame) -> DataFrame:
    """System and user prompt per complete context row."""
    user = render.user_prompt(
        render.context_text(), render.pattern_section(F.col("matches")),
        render.incident_section(F.col("similar_incidents")),
    )
    return contexts.where("has_context").select(
        "failure_id", F.lit(render.SYSTEM_PROMPT).alias("system_prompt"), user.alias("user_prompt")
    )
