"""Stateless operators on streams: the cleaning chain, tagging and scoring
with a fitted model work unchanged on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..operators import tagging as T


def cleaned_stream(stream: DataFrame, text: str = "text") -> DataFrame:
    """H1 + H12 + H3..H11 on each arriving document."""
    return stream.select("doc_id", C.clean_text(C.strip_quotes(text)).alias("clean"))


def tagged_stream(stream: DataFrame, groups: dict | None = None, text: str = "text") -> DataFrame:
    """Cleaning, words, tags and pre-processed terms per arriving document."""
    d = stream.withColumn("clean", C.clean_text(C.strip_quotes(text))).withColumn("words", C.words(F.col("clean")))
    return T.preprocess(T.tag_words(d), groups)


def scored_stream(stream: DataFrame, model, groups: dict | None = None) -> DataFrame:
    """J7 on a stream: apply a fitted fused PipelineModel to new documents."""
    return model.transform(tagged_stream(stream, groups)).select("doc_id", F.col("predicted").alias("prediction"))
