"""The same operators on a stream of failures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline import schemas
from faultline.sources import sinks
from faultline.sources.readers import CORRUPT, normalise_state, shape_failure_events

STREAM_SCHEMA = (
    "event_id bigint, dag_id string, task_id string, run_id string, state string, try_number int, "
    "error_message string, error_category string, failed_at timestamp"
)


def stream_failures(spark: SparkSession, path: str, schema: str = STREAM_SCHEMA, max_files: int | None = None) -> DataFrame:
    """Failure events from a folder that receives JSON files."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path).withColumn("state", normalise_state(F.col("state")))


def stream_callbacks(
    spark: SparkSession, path: str, arrived: str | None = None, wall_clock: bool = False, max_files: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(failures, quarantine) from a folder that receives callback payloads as JSON lines.

    The rules are those of ``read_failure_events``.  The event time is the arrival: the payload field ``arrived``, else the
    time of the micro-batch.  Both frames read the folder, each with a checkpoint of its own.
    """
    schema = f"{schemas.FAILURE_EVENT_JSON}, {CORRUPT} string" + (f", {arrived} string" if arrived else "")
    reader = spark.readStream.schema(schema).option("columnNameOfCorruptRecord", CORRUPT)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    when = F.try_to_timestamp(F.col(arrived)) if arrived else None
    shaped = shape_failure_events(reader.json(path), when, wall_clock)
    return shaped.where("problem IS NULL").drop("problem"), shaped.where("problem IS NOT NULL")


def dedupe_attempts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One event per task of a run, however many attempts call back.  State is dropped behind the watermark."""
    return events.withWatermark("failed_at", delay).dropDuplicatesWithinWatermark(["dag_id", "run_id", "task_id"])


def failure_rate_windows(runs: DataFrame, time: str = "execution_date", delay: str = "1 hour") -> DataFrame:
    """Failure rate per DAG over 7 days, every day.  Counts combine per task before the shuffle."""
    return runs.withWatermark(time, delay).groupBy(F.window(time, "7 days", "1 day"), "dag_id").agg(
        F.count("*").alias("total_runs"), F.count_if(F.col("state") == "failed").alias("failed_runs")
    ).select(
        "dag_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "total_runs", "failed_runs", (F.col("failed_runs") / F.col("total_runs")).alias("failure_rate"),
    )


def retry_sessions(events: DataFrame, gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Bursts of attempts of one task, closed after a quiet gap."""
    return events.withWatermark("failed_at", delay).groupBy(
        F.session_window("failed_at", gap), "dag_id", "task_id"
    ).agg(F.count("*").alias("attempts")).select(
        "dag_id", "task_id", F.col("session_window.start").alias("session_start"),
        F.col("session_window.end").alias("session_end"), "attempts",
    )


def recurrence_windows(events: DataFrame, delay: str = "1 hour", days: int = 30) -> DataFrame:
    """How often each (dag, task, category) failed in the 30 days up to every midnight.

    A sliding window keeps one counter per key and day; a per-key timer would pull a hot key's events into one task.
    """
    return events.withWatermark("failed_at", delay).groupBy(
        F.window("failed_at", f"{days} days", "1 day"), "dag_id", "task_id", "error_category"
    ).agg(F.count("*").alias("failures")).select(
        "dag_id", "task_id", "error_category", F.col("window.end").alias("as_of"), "failures"
    )


def run_once(df: DataFrame, path: str, checkpoint: str) -> None:
    """Drains the available input into parquet, in append mode, and stops."""
    query = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option(
        "path", path).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_triage(
    events: DataFrame, batch_plan: Callable[[DataFrame], DataFrame], report_path: str, checkpoint: str,
    incident_path: str | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Event to report per micro-batch: the batch plan, with the surroundings as static tables.

    A batch that is replayed after a failure overwrites its own folder and appends no incident twice.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = f"{report_path}/batch={batch_id}"
        # The plan reads its failures more than once; the source should not.
        batch.persist()
        batch_plan(batch).write.mode("overwrite").parquet(target)
        batch.unpersist()
        if incident_path is not None:
            sinks.append_incidents(spark, spark.read.parquet(target), incident_path)

    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


__all__ = [
    "STREAM_SCHEMA", "dedupe_attempts", "failure_rate_windows", "recurrence_windows", "retry_sessions", "run_once",
    "stream_callbacks", "stream_failures", "stream_triage",
]
