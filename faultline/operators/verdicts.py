"""Replies to verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.functions import verdict as v
from faultline.functions.text import pinned, strip


def parse_replies(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``model_verdict``: the validated verdict in the reply, null where it holds none.

    The whole text is tried first, then its outermost object.  Each step is pinned, so that no step is computed again
    for every field read from it.
    """
    read = pinned(replies, _content=strip(v.strip_fence(F.col(raw))))
    read = pinned(read, _whole=v.parse_whole(F.col("_content")))
    read = pinned(read, _first=v.typed_verdict(F.col("_whole"))).drop("_whole")
    read = pinned(read, _object=F.when(F.col("_first").isNull(), v.outermost_object(F.col("_content"))))
    read = pinned(read, _inner=v.parse_whole(F.col("_object"))).drop("_object")
    return (
        pinned(read, model_verdict=F.coalesce("_first", v.typed_verdict(F.col("_inner"))))
        .drop("_content", "_first", "_inner")
    )


def choose_verdict(
    df: DataFrame, evidence: int = v.MAX_EVIDENCE, primary: str = "primary", model: str = "model_verdict"
) -> DataFrame:
    """Adds ``verdict``: the model's where valid, else the fallback, and ``verdict_source``."""
    return df.withColumn(
        "verdict", F.coalesce(F.col(model), v.fallback_verdict(F.col(primary), evidence))
    ).withColumn("verdict_source", F.when(F.col(model).isNotNull(), "model").otherwise("rules"))
