"""One wide row per failure: task, log, history, changes, sources, metrics, and what is missing."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from faultline import schemas
from faultline.operators import commits as commit_ops
from faultline.session import settled

logger = logging.getLogger(__name__)

# Error texts.
COLLECTION_FAILED = "Airflow collection failed"
NO_CONTEXT = "Cannot build context: missing Airflow data"
NO_ANALYSIS = "No context for LLM analysis"

TASK_KEYS = ["dag_id", "run_id", "task_id"]
LOG_KEYS = ["dag_id", "run_id", "task_id", "try_number"]

Provider = Callable[[DataFrame], DataFrame]


def failure_id(*columns: str) -> Column:
    """A stable id, so that a replay finds its own rows again.  A null part differs from every text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns]), 256)


def of_failures(rows: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that some failure asks for.  Only the failures' keys are shuffled (or broadcast) to find them."""
    return rows.join(failures.select(*keys).distinct(), keys, "left_semi")


def join_task_instances(failures: DataFrame, instances: DataFrame) -> DataFrame:
    """Adds the struct ``task`` by (dag, run, task); null where there is no instance.

    Of several attempts the newest at or below the failure's try is taken, else the earliest later one, so a
    failure stays one row.
    """
    one = _nearest_instances(failures, instances, [*TASK_KEYS, "_try"])
    asked = failures.withColumn("_try", F.coalesce("try_number", F.lit(1)))
    return asked.join(one, [*TASK_KEYS, "_try"], "left").select(*failures.columns, "task")


def task_instances_of(failures: DataFrame, instances: DataFrame, key: str = "failure_id") -> DataFrame:
    """(failure_id, task): the same by the failure's id, which stands for dag, run, task and try."""
    return _nearest_instances(failures, instances, [key])


def _nearest_instances(failures: DataFrame, instances: DataFrame, by: list[str]) -> DataFrame:
    task = F.struct(
        "state", "start_date", "end_date", "duration_seconds", "try_number", "max_tries", "operator", "pool", "queue"
    ).cast(schemas.TASK)
    names = list(dict.fromkeys([*by, *TASK_KEYS, "_try"]))
    wanted = failures.withColumn("_try", F.coalesce("try_number", F.lit(1))).select(*names).distinct()
    reached = F.coalesce(F.col("task.try_number"), F.lit(1)) <= F.col("_try")
    nearest = F.struct(reached.alias("reached"), F.when(reached, F.col("task.try_number")).otherwise(-F.col("task.try_number")))
    return (
        instances.select(*TASK_KEYS, task.alias("task")).join(wanted, TASK_KEYS)
        .groupBy(*by).agg(F.max_by("task", F.struct(nearest.alias("nearest"), "task")).alias("task"))
    )


def join_logs(failures: DataFrame, profiled: DataFrame) -> DataFrame:
    """Adds the log's columns by (dag, run, task, try).  Join the profile, not the text: texts need no shuffle.

    Of several logs of one attempt the one with most lines is taken.
    """
    return failures.join(_longest_logs(profiled, LOG_KEYS), LOG_KEYS, "left")


def logs_of(profiled: DataFrame, key: str = "failure_id") -> DataFrame:
    """(failure_id, the log's columns): the same by the failure's id.  A log that lacks a key belongs to no failure."""
    known = profiled.where(" AND ".join(f"{k} IS NOT NULL" for k in LOG_KEYS))
    return _longest_logs(known.withColumn(key, failure_id("dag_id", "task_id", "run_id", "try_number")), [key])


def _longest_logs(profiled: DataFrame, by: list[str]) -> DataFrame:
    columns = [c for c in profiled.columns if c not in [*LOG_KEYS, *by]]
    longest = F.max_by(F.struct(*columns), F.struct("log_lines", "stdout_tail"))
    return profiled.groupBy(*by).agg(longest.alias("_log")).select(*by, "_log.*")


def join_recent_commits(
    rows: DataFrame, failures: DataFrame, commits: DataFrame, hours: int = commit_ops.LOOKBACK_HOURS,
    limit: int = commit_ops.MAX_COMMITS, key: str = "failure_id", time: str = "failed_at",
) -> DataFrame:
    """Adds ``recent_commits`` by failure.  The lists are made on the failures' ids alone; of an id that comes with several
    times or repositories each row takes its own."""
    own = [*commit_ops.repository_of(failures, commits), time]
    listed = commit_ops.recent_commits(failures.select(key, *own).distinct(), commits, time, hours, limit)
    one = listed.groupBy(key).agg(F.collect_list(F.struct(*own, "recent_commits")).alias("_lists"))

    def is_own(x: Column) -> Column:
        return reduce(and_, [x[k].eqNullSafe(F.col(k)) for k in own])

    columns = [c for c in rows.columns if c != "recent_commits"]
    return rows.join(one, key, "left").select(
        *columns, F.get(F.filter("_lists", is_own), F.lit(0))["recent_commits"].alias("recent_commits"))


def join_history(failures: DataFrame, history: DataFrame, key: str = "failure_id") -> DataFrame:
    """Adds the struct ``dag_history`` by failure."""
    columns = [c for c in history.columns if c != key]
    return failures.join(history.select(key, F.struct(*columns).alias("dag_history")), key, "left")


def join_similar(failures: DataFrame, similar: DataFrame) -> DataFrame:
    """Adds ``similar_incidents`` by failure; an empty list where there are none."""
    one = similar.groupBy("failure_id").agg(F.max("similar_incidents").alias("similar_incidents"))
    none = F.array().cast(f"array<{schemas.SIMILAR}>")
    return failures.join(one, "failure_id", "left").withColumn(
        "similar_incidents", F.coalesce(F.col("similar_incidents").cast(f"array<{schemas.SIMILAR}>"), none))


def absent(df: DataFrame, **columns: str) -> DataFrame:
    """Typed nulls (or empty arrays) for inputs that are switched off."""
    for name, dtype in columns.items():
        value = F.array() if dtype.startswith("array<") else F.lit(None)
        df = df.withColumn(name, value.cast(dtype))
    return df


def gate(contexts: DataFrame) -> DataFrame:
    """Adds ``has_context`` and ``errors``: without task or log there is no context and no verdict."""
    complete = F.col("task").isNotNull() & F.col("log_lines").isNotNull()
    missing = F.array(F.lit(COLLECTION_FAILED), F.lit(NO_CONTEXT), F.lit(NO_ANALYSIS))
    none = F.array().cast("array<string>")
    previous = F.coalesce(F.col("errors"), none) if "errors" in contexts.columns else none
    return contexts.withColumn("has_context", complete).withColumn(
        "errors", F.concat(previous, F.when(complete, none).otherwise(missing))
    )


def collectors_used() -> Column:
    """Which inputs contributed, in fixed order."""
    return F.array_compact(F.array(
        F.lit("airflow"),
        F.when(F.col("git").isNotNull(), F.lit("git")),
        F.when(F.size("sources") > 0, F.lit("source_health")),
        F.when(F.col("metrics").isNotNull(), F.lit("metrics")),
    ))


@dataclass(frozen=True)
class Declared:
    """A provider that names its columns, so that a failed one leaves a null of the same type."""

    function: Provider
    schema: str

    def __call__(self, failures: DataFrame) -> DataFrame:
        return self.function(failures)


# What is left of a provider that failed before it named any column.
NO_COLUMNS = "failure string"


def provided(provider: Provider, name: str, failures: DataFrame, key: str = "failure_id") -> tuple[DataFrame | None, str, str | None]:
    """(rows by key as a written table, type of the struct, error): a provider is run by itself and never fails the caller.

    Errors while it is planned (it raises, or names columns that do not exist) and while it is run (a task fails for good) end in the
    error's text and no rows.  The first row of a failure by its columns' order is taken, so failures are not multiplied.
    """
    dtype = f"struct<{getattr(provider, 'schema', NO_COLUMNS)}>"
    try:
        rows = provider(failures)
        columns = [c for c in rows.columns if c != key]
        one = rows.groupBy(key).agg(F.min(F.struct(*columns)).alias(name))
        dtype = dict(one.dtypes)[name]
        if hasattr(provider, "schema"):
            dtype = f"struct<{provider.schema}>"
            one = one.withColumn(name, F.col(name).cast(dtype))
        return settled(one, "provider"), dtype, None
    except Exception as problem:
        # The message's first line: what follows is a stack trace of the task.
        text = str(problem).strip().split("\n")[0]
        logger.warning("provider %s failed: %s", name, text)
        return None, dtype, f"{name} collection failed: {text}"


def add_providers(contexts: DataFrame, providers: dict[str, Provider], key: str = "failure_id",
                  failures: DataFrame | None = None) -> DataFrame:
    """Left-joins each provider's rows as a struct named after it.

    A provider maps the failures (``failures``, or else ``contexts``), written once and narrow, to rows keyed by failure
    id.  One that fails gives a null struct and an entry in ``errors``; the others and the run go on.
    """
    asked = settled(contexts if failures is None else failures, "provider-keys")
    problems = []
    for name, provider in providers.items():
        rows, dtype, problem = provided(provider, name, asked, key)
        if problem is None:
            contexts = contexts.join(rows, key, "left")
        else:
            contexts = contexts.withColumn(name, F.lit(None).cast(dtype))
            problems.append(problem)
    none = F.array().cast("array<string>")
    if "errors" not in contexts.columns:
        contexts = contexts.withColumn("errors", none)
    return contexts.withColumn("errors", F.concat("errors", F.array(*[F.lit(p) for p in problems]))) if problems else contexts
