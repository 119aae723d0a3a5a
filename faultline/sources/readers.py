"""Readers with declared schemas.  A row that breaks the rules goes to a quarantine frame, never fails the job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from faultline import schemas
from faultline.functions.text import first_line, parse_instant
from faultline.session import settled

CORRUPT = "_corrupt_record"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def normalise_state(state: Column) -> Column:
    """States outside the known ones count as failed."""
    return F.when(state.isin(schemas.FAILURE_STATES), state).otherwise(F.lit("failed"))


def shape_failure_events(raw: DataFrame, arrived: Column | None = None, wall_clock: bool = False) -> DataFrame:
    """Callback payloads to failure rows plus ``problem``, which is null for good rows."""
    when = parse_instant(F.col("execution_date"), wall_clock)
    required = [F.col(c).isNull() for c in ("dag_id", "task_id", "run_id", "state")]
    missing = required[0]
    for condition in required[1:]:
        missing = missing | condition
    corrupt = F.col(CORRUPT).isNotNull() if CORRUPT in raw.columns else F.lit(False)
    return raw.select(
        "dag_id", "task_id", "run_id", when.alias("execution_date"), normalise_state(F.col("state")).alias("state"),
        F.col("exception").alias("error_message"), F.coalesce("try_number", F.lit(1)).alias("try_number"),
        (F.current_timestamp() if arrived is None else arrived).alias("failed_at"),
        F.when(corrupt, "malformed JSON").when(missing, "missing field").when(when.isNull(), "bad execution_date")
        .alias("problem"),
    )


def read_failure_events(
    spark: SparkSession, path: str, arrived: str | None = None, wall_clock: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(failures, quarantine) from JSON lines.  ``arrived`` names a payload field that holds the arrival time."""
    schema = f"{schemas.FAILURE_EVENT_JSON}, {CORRUPT} string" + (f", {arrived} string" if arrived else "")
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    shaped = shape_failure_events(raw, F.try_to_timestamp(F.col(arrived)) if arrived else None, wall_clock)
    return shaped.where("problem IS NULL").drop("problem"), shaped.where("problem IS NOT NULL")


def duration_seconds(start: Column, end: Column) -> Column:
    """Whole microseconds first: the difference of two epoch doubles is off in the seventh decimal."""
    return (F.unix_micros(end) - F.unix_micros(start)) / 1_000_000


def read_task_instances(spark: SparkSession, path: str, wall_clock: bool = False) -> DataFrame:
    raw = _json(spark, path, schemas.TASK_INSTANCE_JSON)
    start, end = (parse_instant(F.col(c), wall_clock) for c in ("start_date", "end_date"))
    return raw.select(
        "dag_id", "task_id", "run_id", F.coalesce("state", F.lit("unknown")).alias("state"),
        start.alias("start_date"), end.alias("end_date"), duration_seconds(start, end).alias("duration_seconds"),
        F.coalesce("try_number", F.lit(1)).alias("try_number"), F.coalesce("max_tries", F.lit(1)).alias("max_tries"),
        "operator", "pool", "queue",
    )


def path_decode(text: Column) -> Column:
    """Percent decoding of a path, in which (unlike a form) a plus is itself.  What is no encoding stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


# Fixed value: where a log file's path carries its keys.
LOG_PATH = r"dags/([^/]+)/dagRuns/([^/]+)/taskInstances/([^/]+)/logs/(\d+)"


def read_task_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per log file, keys taken from the path."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    part = lambda i: path_decode(F.regexp_extract(name, LOG_PATH, i))
    return raw.select(
        part(1).alias("dag_id"), part(2).alias("run_id"), part(3).alias("task_id"),
        F.regexp_extract(name, LOG_PATH, 4).cast("int").alias("try_number"), F.col("value").alias("stdout"),
    )


def _numbered_in_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, split, at, line): ``at`` numbers the lines of each split of a file in the order in which the reader yields them."""
    now, seen = None, 0
    for batch in batches:
        paths, splits = batch.column(0), batch.column(1).to_numpy()
        names = paths.dictionary_encode()
        codes = names.indices.to_numpy()
        edge = np.flatnonzero((np.diff(codes) != 0) | (np.diff(splits) != 0)) + 1
        at = np.zeros(batch.num_rows, np.int64)
        for start, stop in zip([0, *edge], [*edge, batch.num_rows], strict=True):
            if start == stop:
                continue
            place = (paths[int(start)].as_py(), int(splits[start]))
            seen = seen if place == now else 0
            now = place
            at[start:stop] = np.arange(seen, seen + stop - start)
            seen += stop - start
        yield pa.RecordBatch.from_arrays([paths, batch.column(1), pa.array(at), batch.column(2)], names=["path", "split", "at", "line"])


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(dag_id, run_id, task_id, try_number, line_no, line): the lines of log files of any size, numbered from 0 in their file.

    A file is read in splits by many tasks.  Each numbers its own lines; the lines of a file's earlier splits, a running total over
    one row a split, are added, so no text is shuffled and no task holds a file.  The lines are written as a table first, since a
    second reading might cut the files elsewhere.  Lines end at ``\\n`` alone; the end of the last one makes no line of its own,
    and an empty file has no lines.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    rows = raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))
    table = settled(rows.mapInArrow(_numbered_in_split, "path string, split bigint, at bigint, line string"), "log-lines")
    counts = table.groupBy("path", "split").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # Files of one split need no total: what is broadcast has a row for each further split of the large files.
    before = counts.withColumn("before", F.sum("n").over(earlier)).where("before IS NOT NULL").drop("n")
    part = lambda i: path_decode(F.regexp_extract("path", LOG_PATH, i))
    return table.join(F.broadcast(before), ["path", "split"], "left").select(
        part(1).alias("dag_id"), part(2).alias("run_id"), part(3).alias("task_id"),
        F.regexp_extract("path", LOG_PATH, 4).cast("int").alias("try_number"),
        (F.col("at") + F.coalesce("before", F.lit(0))).alias("line_no"), "line")


def read_dag_runs(spark: SparkSession, path: str, wall_clock: bool = False) -> DataFrame:
    raw = _json(spark, path, schemas.DAG_RUN_JSON)
    start, end = (parse_instant(F.col(c), wall_clock) for c in ("start_date", "end_date"))
    return raw.select(
        "dag_id", "run_id", F.coalesce("state", F.lit("unknown")).alias("state"),
        parse_instant(F.col("execution_date"), wall_clock).alias("execution_date"),
        duration_seconds(start, end).alias("duration_seconds"),
    )


def shape_commits(raw: DataFrame) -> DataFrame:
    """Short sha, first line of the message, instant; the repository where the rows name it."""
    date = F.col("date") if dict(raw.dtypes)["date"] == "timestamp" else F.try_to_timestamp(F.col("date"))
    return raw.select(
        "sha", F.substring("sha", 1, 7).alias("short_sha"), "author", "email",
        first_line(F.col("message")).alias("message"), date.alias("date"),
        F.coalesce("files_changed", F.array().cast("array<string>")).alias("files_changed"),
        *([F.coalesce("repository", F.lit("")).alias("repository")] if "repository" in raw.columns else []),
    )


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """Commits without ``repository`` are of one, named by the empty text."""
    return shape_commits(_json(spark, path, schemas.COMMIT_JSON))


def read_dag_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every Python file under a folder, the path relative to it."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").text(
        root, wholetext=True)
    # The folder as the file system names it, which is how every file's path begins.
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    folder = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder)
    prefix = F.lit(folder.toUri().getPath().rstrip("/") + "/")
    full = path_decode(F.regexp_replace(F.col("_metadata.file_path"), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""))
    path = F.when(full.startswith(prefix), F.substr(full, F.length(prefix) + 1)).otherwise(full)
    return raw.select(path.alias("path"), F.col("value").alias("content"))


def read_source_checks(spark: SparkSession, path: str) -> DataFrame:
    raw = _json(spark, path, schemas.SOURCE_CHECK_JSON)
    return raw.withColumn("last_checked", F.try_to_timestamp(F.col("last_checked")))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.METRICS).parquet(path)


def read_external_events(spark: SparkSession, path: str) -> DataFrame:
    raw = _json(spark, path, schemas.EXTERNAL_EVENT_JSON)
    return raw.select("event_id", F.try_to_timestamp(F.col("ts")).alias("event_time"), "dag_id", "task_id", "title")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.REPLY_JSON)


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """The history, whose folders are days; ``stored_ids`` reads some of them."""
    return spark.read.schema(f"{schemas.INCIDENT}, {DAY} date").parquet(path).drop(DAY)


#: Partition column of a history: the day of ``date``.
DAY = "day"


def stored_ids(spark: SparkSession, path: str, days: list) -> DataFrame:
    """incident_id of the incidents of these days (null: those without date); files of other days are not opened."""
    rows = spark.read.schema(f"{schemas.INCIDENT}, {DAY} date").parquet(path)
    known = [F.lit(d) for d in days if d is not None]
    wanted = F.col(DAY).isin(*known) if known else F.lit(False)
    return rows.where(wanted | F.col(DAY).isNull() if None in days else wanted).select("incident_id")
