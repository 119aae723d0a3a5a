"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Sides of joins are broadcast by their measured size only.  Guesses from compressed files fall short by any factor (texts that repeat,
#: hashes, lists), and AQE does not take back a broadcast once planned, so tables that grow with the input would pass the driver.
MEASURED_BROADCASTS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
}


def build_session(app: str = "faultline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on.  ``conf`` overrides any of them.

    Shuffle width is left to the cluster: AQE coalesces small partitions and splits skewed ones, so the number is
    only an upper bound there.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Bursts of one task merge before the shuffle, so a hot task arrives as few rows.
        "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
        **MEASURED_BROADCASTS,
        "spark.ui.enabled": "false",
        # A call site is otherwise captured for every Column built; plans here are made of thousands.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def mounted(folder: str) -> str:
    """A shared folder as a path that Python can open; a remote scheme cannot be."""
    path = folder.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError(f"{folder} is not a mounted folder: write parquet there instead of single files")
    return path


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """The frame as a written table in the shared folder, for results that are costly and read several times."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder path in the folder that all executors share.

    That is ``spark.checkpoint.dir`` or, where a program set it later, the context's checkpoint folder.  There is no other
    choice: a machine-local folder would lose data with the executor that wrote it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/faultline/{purpose}-{uuid.uuid4().hex}"
