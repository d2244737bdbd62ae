"""Readers for the parquet tables and the labelled corpus built from them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def label_expr(toxic="toxic", quality="quality"):
    """Three-class label from the label table's flags."""
    return (F.when(F.col(toxic) == 1, F.lit("negative"))
            .when(F.col(quality) == 1, F.lit("positive"))
            .otherwise(F.lit("neutral")))


SQL_LABEL = ("CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' "
             "ELSE 'neutral' END")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined to their labels on ``doc_id`` (never by position).

    Plain equi-join: Catalyst/AQE choose broadcast or sort-merge from the
    runtime size of ``labels``; nothing is forced.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", label_expr().alias("label"))
    return docs.join(labels, "doc_id", "inner")
