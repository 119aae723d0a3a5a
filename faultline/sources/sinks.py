"""Writers.  Sending to a chat service or a model is outside: the payload is written for a sender to pick up."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from faultline import schemas
from faultline.functions import render
from faultline.functions.vectors import add_vector
from faultline.operators import incidents, reports
from faultline.session import mounted, settled
from faultline.sources.readers import DAY, read_incidents, stored_ids


#: Folder of the model within a history; readers of Parquet skip names that begin with an underscore.
VECTORISER = "_vectoriser"


def write_reports(report_rows: DataFrame, path: str, mode: str = "append") -> None:
    """(report_id, file_name, body) by day of failure."""
    report_rows.select(
        "report_id", render.file_name().alias("file_name"), render.markdown().alias("body"),
        F.to_date("failure_time").alias("failure_date"),
    ).write.mode(mode).partitionBy("failure_date").parquet(path)


def write_report_files(report_rows: DataFrame, folder: str) -> None:
    """One text file per report, in a folder that all executors mount.  Rewriting a file is harmless on a retry."""
    folder = mounted(folder)

    def save(rows: Iterator) -> None:
        import os

        os.makedirs(folder, exist_ok=True)
        for row in rows:
            with open(os.path.join(folder, row.file_name.replace("/", "_")), "w", encoding="utf-8") as out:
                out.write(row.body)

    report_rows.select(render.file_name().alias("file_name"), render.markdown().alias("body")).foreachPartition(save)


def write_notifications(report_rows: DataFrame, path: str, channel: str | None = None, mode: str = "append") -> None:
    """One JSON payload per line."""
    reports.notifications(report_rows, channel).select(F.col("payload").alias("value")).write.mode(mode).text(path)


def write_prompts(contexts: DataFrame, path: str, mode: str = "append") -> None:
    reports.prompts(contexts).write.mode(mode).parquet(path)


def append_incidents(spark: SparkSession, report_rows: DataFrame, path: str) -> None:
    """Appends the reports whose id is not stored yet.  Running it twice appends nothing.

    The history is kept by day, and an id belongs to the day of its failure, so ids are only looked up in the days that the reports
    have; their number, not the reports', reaches the driver.  Where the history keeps a vectoriser, each incident is stored with
    the vector of its text, so that later searches find it, and with the vectoriser's version.
    """
    records = incidents.incident_records(report_rows, with_text=True)
    days = [r.day for r in records.select(F.to_date("date").alias("day")).distinct().collect()]
    model = stored_vectoriser(spark, path)
    fresh = incidents.new_incidents(stored_ids(spark, path, days), records)
    write_by_day(with_vectors(fresh.withColumn("text", F.col("_text")), "_text", model).drop("_text"), path, "append")


def with_vectors(rows: DataFrame, text: str, model: Transformer | None) -> DataFrame:
    """Adds the vector of a text and the version of the model that made it; nulls without model or text."""
    none = {"embedding": F.lit(None).cast("array<float>"), "vector_version": F.lit(None).cast("string")}
    if model is None:
        return rows.withColumns(none)
    made = add_vector(rows.drop("embedding"), text, model).withColumn("vector_version", F.lit(vector_version(model)))
    return made.unionByName(rows.where(F.col(text).isNull()).withColumns(none).select(made.columns))


def vector_version(model: Transformer) -> str:
    """A fitted model keeps its id when it is saved and loaded."""
    return model.uid


def write_by_day(rows: DataFrame, path: str, mode: str) -> None:
    """Rows of a history, one folder for each day."""
    kept = [f.name for f in StructType.fromDDL(schemas.INCIDENT)]
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schemas.INCIDENT) if f.name not in rows.columns]
    shaped = rows.select("*", *missing).select(*kept, F.to_date("date").alias(DAY))
    # An overwrite replaces the days that the rows have.
    shaped.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def create_incidents(spark: SparkSession, path: str, vectoriser: PipelineModel | None = None) -> None:
    """An empty history, and the fitted model that makes the vectors of its incidents."""
    write_by_day(spark.createDataFrame([], schemas.INCIDENT), path, "ignore")
    if vectoriser is not None:
        vectoriser.write().overwrite().save(f"{path}/{VECTORISER}")


def stored_vectoriser(spark: SparkSession, path: str) -> PipelineModel | None:
    """The model kept with the history, if there is one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{VECTORISER}")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return PipelineModel.load(f"{path}/{VECTORISER}")


def write_incident_version(incident_rows: DataFrame, path: str) -> None:
    """A new version of the history; parquet cannot be updated in place, so ``path`` must be a new folder."""
    write_by_day(incident_rows, path, "error")


def upsert_resolutions(spark: SparkSession, path: str, updates: DataFrame) -> None:
    """Sets the last resolution written for each stored incident, in place: only the days that hold such an incident are read whole
    and written again, the files of the others stay as they are.

    The new rows are first written elsewhere, so updates that cannot be computed leave the history untouched; the days are then
    replaced when all their files are written.  Doing it again gives the same rows.
    """
    rows = spark.read.schema(f"{schemas.INCIDENT}, {DAY} date").parquet(path)
    hit = rows.select("incident_id", DAY).join(updates.select("incident_id").distinct(), "incident_id", "left_semi")
    days = [r[DAY] for r in hit.select(DAY).distinct().collect()]
    if not days:
        return
    known = [F.lit(d) for d in days if d is not None]
    touched = rows.where(F.col(DAY).isin(*known) | (F.col(DAY).isNull() if None in days else F.lit(False)))
    fixed = incidents.apply_resolutions(touched.drop(DAY), updates).drop("resolution_updated")
    write_by_day(settled(fixed, "resolved"), path, "overwrite")


def refresh_vectors(spark: SparkSession, path: str, new_path: str, vectoriser: PipelineModel) -> None:
    """A new version of the history in which every vector is made by ``vectoriser``, which is stored with it.

    Only rows with a text and another version are embedded again; vectors of this version are copied.  A row without stored text
    keeps no vector, since it could not be compared with the others.
    """
    rows = read_incidents(spark, path)
    current = F.coalesce(F.col("vector_version") == vector_version(vectoriser), F.lit(False))
    stale = with_vectors(rows.where(~current).withColumn("_text", F.col("text")), "_text", vectoriser).drop("_text")
    write_by_day(rows.where(current).unionByName(stale), new_path, "error")
    vectoriser.write().overwrite().save(f"{new_path}/{VECTORISER}")
