"""Infrastructure metrics and monitoring events around a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.operators.timeline import Timeline, asof_join

# The window around the failure.
MINUTES_BEFORE, MINUTES_AFTER = 30, 5


def metrics_asof(failures: DataFrame, metrics: DataFrame, time: str = "failed_at", order: list[str] = ()) -> DataFrame:
    """Adds ``metrics``, the newest snapshot at or before the failure."""
    return asof_join(failures, [metrics_timeline(metrics, order)], [], time)


def metrics_timeline(metrics: DataFrame, order: list[str] = ()) -> Timeline:
    snapshot = F.struct(
        "timestamp", "cpu_percent", "memory_percent", "memory_used_gb", "disk_percent", "active_connections",
        "worker_slots_available",
    )
    return Timeline(metrics, "timestamp", {"metrics": snapshot}, tuple(order))


def external_events_window(
    failures: DataFrame, events: DataFrame, time: str = "failed_at",
    before: int = MINUTES_BEFORE, after: int = MINUTES_AFTER,
) -> DataFrame:
    """Pairs of a failure and an event of its DAG and task in [failure - 30 min, failure + 5 min].

    Both sides carry the bucket of the window's length, so the range test runs inside an equi-join.
    """
    span = (before + after) * 60
    begin = F.col(time) - F.expr(f"INTERVAL {before} MINUTES")
    end = F.col(time) + F.expr(f"INTERVAL {after} MINUTES")
    bucket = lambda ts: F.floor(F.unix_seconds(ts) / F.lit(span))
    left = failures.withColumn("_bucket", F.explode(F.sequence(bucket(begin), bucket(end))))
    right = events.withColumn("_bucket", bucket(F.col("event_time")))
    return left.join(right, ["dag_id", "task_id", "_bucket"]).where(
        F.col("event_time").between(begin, end)
    ).drop("_bucket")
