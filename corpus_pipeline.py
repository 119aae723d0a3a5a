"""The text pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import pipeline_stages as stages
from faultline.session import settled

STAGES = [
    ("language_id", stages.language_stage),
    ("quality", stages.quality_stage),
    ("near_copies", stages.near_copy_stage),
    ("decontamination", stages.decontamination_stage),
    ("segmentation", stages.segmentation_stage),
]

#: No SQL: language automata, sampled weights and sampled segmentations are beyond it.  Tested by parts instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
