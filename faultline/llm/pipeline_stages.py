"""The stages of the text pipeline.  A stage takes (spark, docs, sf_dir), decides on every row of ``docs`` and returns a
frame; all but the last return the columns of ``docs``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, jaccard_join, language, resampling, segmentation
from .common import table

#: Below this a text shares hardly two characters in a row with any language learned.
LEAST_LANGUAGE_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that no learned language reads; the model is fitted on labelled rows."""
    model = language.fit(language.sampled_texts(docs, F.lit(True)))
    if model is None:
        return docs.limit(0)
    judged = language.identify(docs, model)
    kept = judged.where((F.col("lang_pred") != language.UNKNOWN_LANGUAGE) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the sample drawn by importance towards the documents labelled good and away from those labelled toxic."""
    sampled = resampling.resample(
        docs, table(spark, sf_dir, "labels"), resampling.good_label(), keep_text=True, toxic=resampling.toxic_label())
    return sampled.where("sampled").select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of the similarity join, the one with the least id."""
    return jaccard_join.without_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def segmentation_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document with their scores: doc_id, lang, source and the operator's columns."""
    rows = docs.select("doc_id", "lang", "source", "text")
    return segmentation.sample_segmentations(rows, public_tokenizers.path("piece_bpe_32k.model"), k=2)
