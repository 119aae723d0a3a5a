"""From failures and their surroundings to reports, as one Catalyst plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, functions as F

from faultline import schemas
from faultline.operators import commits as commit_ops
from faultline.operators import context, health, history, incidents, logs, metrics, reports, verdicts
from faultline.operators.context import Provider, failure_id
from faultline.functions.vectors import add_vector
from faultline.session import settled


@dataclass(frozen=True)
class Options:
    """Settings of a run.  The limits bound what a report lists; rates and counts cover all rows."""

    lookback_hours: int = commit_ops.LOOKBACK_HOURS
    max_commits: int = commit_ops.MAX_COMMITS
    max_runs: int = history.MAX_RUNS
    rate_days: int = history.RATE_DAYS
    max_similar: int = incidents.MAX_SIMILAR
    max_key_lines: int = logs.KEY_LINES
    snippet_before: int = logs.LINES_BEFORE
    snippet_after: int = logs.LINES_AFTER
    snippet_tail: int = logs.TAIL_LINES
    max_evidence: int = verdicts.v.MAX_EVIDENCE
    sources: tuple[str, ...] = ()
    enable_git: bool = True
    enable_source_health: bool = True
    enable_metrics: bool = False
    custom_signatures: tuple | None = None
    model_name: str | None = None


@dataclass(frozen=True)
class Tables:
    """Inputs of a run; all but the first three may be missing.

    ``incidents`` is the history with vectors of its texts and ``vectoriser`` the model that made them: with both, similar
    incidents are searched for.  A ready ``similar`` (failure_id, similar_incidents) replaces the search.  ``replies`` holds
    (failure_id, raw).  ``log_lines`` (dag_id, run_id, task_id, try_number, line_no, line) takes the place of ``task_logs``,
    which is None then, where a log may be too large for one row.
    """

    task_instances: DataFrame
    task_logs: DataFrame | None
    dag_runs: DataFrame
    commits: DataFrame | None = None
    dag_files: DataFrame | None = None
    source_checks: DataFrame | None = None
    metrics: DataFrame | None = None
    incidents: DataFrame | None = None
    vectoriser: Transformer | None = None
    similar: DataFrame | None = None
    replies: DataFrame | None = None
    log_lines: DataFrame | None = None


GIT_TYPE = (
    f"struct<recent_commits:array<{schemas.COMMIT}>,last_commit:{schemas.COMMIT},dag_file_path:string,"
    "hours_since_last_change:double>"
)


def with_ids(failures: DataFrame) -> DataFrame:
    return failures.withColumn("failure_id", failure_id("dag_id", "task_id", "run_id", "try_number"))


def build_context(
    failures: DataFrame, tables: Tables, options: Options = Options(), providers: dict[str, Provider] | None = None,
    complete_only: bool = False,
) -> DataFrame:
    """One context row per failure; with ``complete_only`` those with ``has_context`` alone, for callers that drop the others.

    The as-of steps come first, on narrow rows; wide columns join last, all by the failure's id.  Logs, task instances and runs are first reduced to those the failures ask for; a log's text
    is then reduced to its profile, so texts of other attempts are not read by the classification and none is shuffled.
    Only complete failures go through the as-of steps if no others are wanted.
    """
    with_git = options.enable_git and tables.commits is not None
    with_sources = options.enable_source_health and tables.source_checks is not None and bool(options.sources)
    with_metrics = options.enable_metrics and tables.metrics is not None
    base = with_ids(failures)
    if with_git and tables.dag_files is not None:
        files = commit_ops.resolve_dag_files(base, tables.dag_files).drop("priority")
        base = base.drop(*[c for c in files.columns if c != "dag_id"]).join(files, "dag_id", "left")
    elif with_git and "dag_file_path" not in base.columns:
        base = base.withColumn("dag_file_path", F.lit(None).cast("string"))
    asked = base
    if tables.log_lines is not None:
        profiles = line_profiles(context.of_failures(tables.log_lines, base, context.LOG_KEYS), options)
    else:
        profiles = log_profiles(context.of_failures(tables.task_logs, base, context.LOG_KEYS), options)
    found_logs, found_tasks = context.logs_of(profiles), context.task_instances_of(base, tables.task_instances)
    searched = tables.similar is None and tables.incidents is not None and tables.vectoriser is not None
    if complete_only or searched:
        # Read again: to choose the failures, and by the search.
        found_logs = settled(found_logs, "logs")
    if complete_only:
        found_tasks = settled(found_tasks, "tasks")
        complete = found_tasks.where("task IS NOT NULL").join(found_logs.where("log_lines IS NOT NULL"), "failure_id", "left_semi")
        base = settled(base.join(complete.select("failure_id"), "failure_id", "left_semi").select(*base.columns), "failures")
    rows = base
    if with_git:
        rows = commit_ops.last_commit_asof(rows, tables.commits)
    rows = metrics.metrics_asof(rows, tables.metrics) if with_metrics else context.absent(rows, metrics=schemas.METRICS_SNAPSHOT)
    # All that is wide is one row a failure id: each part is shuffled once, and the rows once by the id, not before every join.
    rows = rows.join(found_tasks, "failure_id", "left")
    rows = rows.join(found_logs, "failure_id", "left")
    past = history.history_asof(base, tables.dag_runs, "failure_id", "failed_at", options.max_runs, options.rate_days)
    rows = context.join_history(rows, past)
    if with_sources:
        found = health.sources_at(base, tables.source_checks, list(options.sources), "failure_id")
        rows = rows.join(found, "failure_id", "left").withColumn(
            "sources", F.coalesce("sources", F.array().cast(f"array<{schemas.SOURCE_HEALTH}>")))
    else:
        rows = context.absent(rows, sources=f"array<{schemas.SOURCE_HEALTH}>")
    if with_git:
        rows = context.join_recent_commits(rows, base, tables.commits, options.lookback_hours, options.max_commits)
        parts = ["recent_commits", "last_commit", "dag_file_path", "hours_since_last_change"]
        rows = rows.withColumn("git", F.struct(*parts)).drop(*parts)
    else:
        rows = context.absent(rows, git=GIT_TYPE)
    if tables.similar is not None:
        rows = context.join_similar(rows, tables.similar)
    elif searched:
        # The search reads the failures' own columns and the logs' snippets, nothing else of a context.
        texts = base.join(found_logs.select("failure_id", "error_snippet"), "failure_id", "left")
        rows = context.join_similar(rows, find_similar(texts, tables, options))
    else:
        rows = context.absent(rows, similar_incidents=f"array<{schemas.SIMILAR}>")
    rows = context.gate(rows)
    return context.add_providers(rows, providers, failures=asked) if providers else rows


def find_similar(contexts: DataFrame, tables: Tables, options: Options = Options()) -> DataFrame:
    """(failure_id, similar_incidents): the nearest stored incidents to what is known of each failure."""
    text = incidents.query_text(F.col("dag_id"), F.col("task_id"), F.col("error_snippet"), F.col("error_message"))
    probes = contexts.select(F.col("failure_id").alias("probe_id"), text.alias("_query")).dropDuplicates(["probe_id"])
    vectors = settled(add_vector(probes, "_query", tables.vectoriser).drop("_query"), "probes")
    found = incidents.similar_incidents(vectors, tables.incidents, options.max_similar)
    return incidents.similar_lists(found, tables.incidents, "probe_id").withColumnRenamed("probe_id", "failure_id")


def log_profiles(task_logs: DataFrame, options: Options = Options()) -> DataFrame:
    """Per attempt: everything later steps read of the log, without the text itself."""
    custom = list(options.custom_signatures) if options.custom_signatures else None
    shaped = logs.profile_logs(
        task_logs, "stdout", options.snippet_before, options.snippet_after, options.snippet_tail)
    profiled = logs.match_logs(shaped, "stdout", custom, key_lines=options.max_key_lines)
    return profiled.select(
        *context.LOG_KEYS, "log_lines", "truncated", "error_snippet", "matches", "key_log_lines",
        logs.tail_chars(F.col("stdout")).alias("stdout_tail"),
    )


def line_profiles(log_lines: DataFrame, options: Options = Options()) -> DataFrame:
    """The same from the logs' lines, without a row that holds a whole text."""
    custom = list(options.custom_signatures) if options.custom_signatures else None
    return logs.profile_lines(
        log_lines, context.LOG_KEYS, options.snippet_before, options.snippet_after, options.snippet_tail, custom,
        options.max_key_lines)


def analyse(
    contexts: DataFrame, tables: Tables, verdict_fn: Callable[[DataFrame], DataFrame] | None = None,
    options: Options = Options(),
) -> DataFrame:
    """Adds ``verdict`` to complete contexts.

    Replies come from ``verdict_fn(prompts) -> (failure_id, raw)`` or from the replies table; without either, or where a
    reply holds no valid verdict, the rules decide.
    """
    replies = tables.replies
    if verdict_fn is not None:
        # Prompts and verdicts read the same contexts, and a model must not be asked twice.
        contexts = settled(contexts, "contexts")
        replies = settled(verdict_fn(reports.prompts(contexts)).select("failure_id", "raw"), "replies")
    complete = contexts.where("has_context").withColumn("primary", F.get("matches", F.lit(0)))
    if replies is not None:
        one = replies.groupBy("failure_id").agg(F.min("raw").alias("raw"))
        parsed = verdicts.parse_replies(one).drop("raw")
        complete = complete.join(parsed, "failure_id", "left")
    else:
        complete = context.absent(complete, model_verdict=verdicts.v.VERDICT_TYPE)
    return verdicts.choose_verdict(complete, options.max_evidence)


def triage(
    failures: DataFrame, tables: Tables, options: Options = Options(),
    providers: dict[str, Provider] | None = None,
    verdict_fn: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One report per failure with task and log."""
    contexts = build_context(failures, tables, options, providers, complete_only=True)
    return reports.build_reports(analyse(contexts, tables, verdict_fn, options), options.model_name)


def classify_logs(task_logs: DataFrame, options: Options = Options()) -> DataFrame:
    """Verdicts from logs alone: no join, no shuffle."""
    keys = [c for c in task_logs.columns if c != "stdout"]
    custom = list(options.custom_signatures) if options.custom_signatures else None
    matched = logs.match_logs(task_logs, "stdout", custom).withColumn("primary", F.get("matches", F.lit(0)))
    judged = verdicts.choose_verdict(context.absent(matched, model_verdict=verdicts.v.VERDICT_TYPE), options.max_evidence)
    return judged.select(*keys, F.col("primary.name").alias("family"), "verdict.*", "key_log_lines")


def add_similar(failures: DataFrame, found: DataFrame, incident_table: DataFrame, probe_id: str) -> DataFrame:
    """(failure_id, similar_incidents) for failures whose ``probe_id`` column names a probe of ``found``."""
    lists = incidents.similar_lists(found, incident_table, "probe_id").withColumnRenamed("probe_id", probe_id)
    return with_ids(failures).select("failure_id", probe_id).join(lists, probe_id).drop(probe_id)
