"""Run history per DAG."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.operators.timeline import DAY, Timeline, asof_join, last_rows, rolling_counts, segmented_scan, with_previous
from faultline.session import settled

# Runs read per DAG, and the rate window.
MAX_RUNS = 20
RATE_DAYS = 7


def newest_runs(runs: DataFrame, limit: int = MAX_RUNS) -> DataFrame:
    """The newest runs per DAG with their ``rank``; every map task keeps at most ``limit`` rows per DAG."""
    order = Window.partitionBy("dag_id").orderBy(
        F.col("execution_date").desc_nulls_last(), F.col("run_id").desc_nulls_last()
    )
    return runs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def newest_date(runs: DataFrame) -> Column:
    """Scalar subquery: the newest execution date of the table."""
    return runs.agg(F.max("execution_date")).scalar()


def dag_history(
    runs: DataFrame, as_of: datetime.datetime | Column | None = None, limit: int = MAX_RUNS, with_runs: bool = False
) -> DataFrame:
    """Statistics over the ``limit`` newest runs of each DAG.

    A duration of zero does not count towards the average, and the rate looks strictly less than 7 days back from
    ``as_of`` (default: the newest execution date of the table).
    """
    if as_of is None:
        as_of = newest_date(runs)
    elif isinstance(as_of, datetime.datetime):
        as_of = F.lit(as_of)
    newest = newest_runs(runs, limit).withColumn(
        "_recent", F.coalesce(F.col("execution_date") > as_of - F.expr(f"INTERVAL {RATE_DAYS} DAYS"), F.lit(False))
    )
    state, date, took = F.col("state"), F.col("execution_date"), F.col("duration_seconds")
    total = F.count_if("_recent")
    failed = F.count_if(F.col("_recent") & (state == "failed"))
    aggregates = [
        F.max(F.when(state == "success", date)).alias("last_success"),
        F.max(F.when(state == "failed", date)).alias("last_failure"),
        F.avg(F.when((state == "success") & (took != 0), took)).alias("avg_duration_seconds"),
        F.when(total > 0, failed / total).otherwise(F.lit(0.0)).alias("failure_rate_7d"),
        total.cast("int").alias("total_runs_7d"),
    ]
    if with_runs:
        aggregates.append(recent_runs_array().alias("recent_runs"))
    return newest.groupBy("dag_id").agg(*aggregates)


def numbered_runs(runs: DataFrame) -> DataFrame:
    """Each dated run with its number ``n`` in its DAG and the number ``failed`` of failed runs up to it."""
    rows = runs.where("dag_id IS NOT NULL AND execution_date IS NOT NULL").select(
        "dag_id", "run_id", "state", "execution_date", "duration_seconds", F.lit(1).cast("bigint").alias("n"),
        (F.col("state") == "failed").cast("bigint").alias("failed"))
    order = ["execution_date", "run_id", "state", "duration_seconds"]
    return segmented_scan(rows, ["dag_id"], order, totals={"n": "n", "failed": "failed"})


def history_asof(
    failures: DataFrame, runs: DataFrame, key: str = "failure_id", time: str = "failed_at", limit: int = MAX_RUNS,
    days: int = RATE_DAYS,
) -> DataFrame:
    """The history of each failure's DAG as it stood at the failure, one row for each ``key``.

    The newest ``limit`` runs up to then give the list, the last success and failure and the mean duration; the rate
    covers all runs of the last ``days`` days, as the difference of two running totals.
    """
    runs = runs.join(failures.select("dag_id").distinct(), "dag_id", "left_semi")
    # Read twice: by the as-of join and by number.
    numbered = settled(numbered_runs(runs), "runs")
    at = F.col(time)
    # Of a failure that comes with several times the latest counts.
    once = failures.groupBy(key, "dag_id").agg(F.max(time).alias(time))
    points = once.select(key, "dag_id", F.posexplode(F.array(at, at - F.expr(f"INTERVAL {days} DAYS"))).alias("_which", "_at"))
    seen = asof_join(points, [Timeline(numbered, "execution_date", {"_seen": F.struct("n", "failed")}, ("n",))], ["dag_id"], "_at")
    counted = seen.groupBy(key, "dag_id").agg(*[
        F.max(F.when(F.col("_which") == i, F.col("_seen"))).alias(name) for i, name in enumerate(("_now", "_then"))
    ]).where("_now IS NOT NULL")
    runs_of = numbered.select("dag_id", "n", F.struct("state", "execution_date", "duration_seconds").alias("value"))
    listed = last_rows(counted.withColumn("_n", F.col("_now.n")), runs_of, ["dag_id"], "_n", limit, "recent_runs")
    newest = lambda state: F.array_max(F.transform(
        F.filter("recent_runs", lambda r: r["state"] == state), lambda r: r["execution_date"]))
    took = F.transform(
        F.filter("recent_runs", lambda r: (r["state"] == "success") & (r["duration_seconds"] != 0)), lambda r: r["duration_seconds"])
    total = F.col("_now.n") - F.coalesce(F.col("_then.n"), F.lit(0))
    failed = F.col("_now.failed") - F.coalesce(F.col("_then.failed"), F.lit(0))
    return listed.select(
        key, newest("success").alias("last_success"), newest("failed").alias("last_failure"),
        F.when(F.size(took) > 0, F.aggregate(took, F.lit(0.0), lambda a, x: a + x) / F.size(took)).alias("avg_duration_seconds"),
        F.when(total > 0, failed / total).otherwise(F.lit(0.0)).alias("failure_rate_7d"),
        total.cast("int").alias("total_runs_7d"), "recent_runs")


def recent_runs_array() -> Column:
    """At most ``limit`` structs per DAG, newest first."""
    ordered = F.sort_array(F.collect_list(F.struct(
        "rank", F.struct("state", "execution_date", "duration_seconds").alias("run")
    )))
    return F.transform(ordered, lambda entry: entry["run"])


def recent_runs(runs: DataFrame, limit: int = MAX_RUNS) -> DataFrame:
    return newest_runs(runs, limit).groupBy("dag_id").agg(recent_runs_array().alias("recent_runs"))


def rolling_failure_rate(runs: DataFrame, days: int = RATE_DAYS) -> DataFrame:
    """Rate over the runs in (t - 7 days, t] as of every run, without the cap on runs read."""
    counted = rolling_counts(
        runs, ["dag_id"], "execution_date",
        {"total_runs_7d": F.lit(1), "failed_runs_7d": (F.col("state") == "failed").cast("int")},
        lower_us=-days * DAY * 1_000_000,
    )
    return counted.withColumn("failure_rate_7d", F.col("failed_runs_7d") / F.col("total_runs_7d"))


def previous_failure(runs: DataFrame) -> DataFrame:
    """The newest failed run strictly before each run of the DAG."""
    return with_previous(
        runs, ["dag_id"], "execution_date", ["run_id"],
        {"previous_failure": F.when(F.col("state") == "failed", F.col("execution_date"))},
    )
