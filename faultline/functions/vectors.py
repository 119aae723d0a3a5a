"""Text vectors and similarity scores."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import HashingTF, IDF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F


def similarity_score(distance: Column) -> Column:
    """1 - distance within [0, 1]; a missing distance counts as 0.5."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.coalesce(distance, F.lit(0.5))))


def fit_vectoriser(corpus: DataFrame, text: str, features: int = 256) -> PipelineModel:
    """Hashed term frequencies, weighted by inverse document frequency, scaled to unit length."""
    return Pipeline(stages=[
        Tokenizer(inputCol=text, outputCol="_tokens"),
        HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_weighted"),
        Normalizer(inputCol="_weighted", outputCol="_unit"),
    ]).fit(corpus.where(F.col(text).isNotNull()))


def add_vector(df: DataFrame, text: str, model: Transformer, output: str = "embedding") -> DataFrame:
    """Adds the vector column, whatever the name of the text column the model was fitted on.

    ``model`` may be any fitted transformer that yields ``_unit`` from the text.  A pipeline whose first stage names no input
    column (a SQL statement) finds it as ``text``.
    """
    column = text
    if isinstance(model, PipelineModel):
        column = getattr(model.stages[0], "getInputCol", lambda: "text")()
    kept = F.struct(*df.columns).alias("_kept")
    out = model.transform(df.where(F.col(text).isNotNull()).select(kept, F.col(text).alias(column)))
    return out.select("_kept.*", vector_to_array("_unit", "float32").alias(output))
