"""Corpus pipeline: documents in, packed training sequences out.

Five stages, each over everything its predecessor kept: documents without a language go,
documents that fail the quality rules go, one document of each near-duplicate group stays,
secrets are replaced in the texts, and what is left is packed into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.language_id import keep_determined
from tagweave.llm.near_dedup import keep_one
from tagweave.llm.packing import pack_documents
from tagweave.llm.quality import keep_good
from tagweave.llm.queries import table, tokenizer_path
from tagweave.llm.secret_scan import redact
from tagweave.session import shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; texts without a letter and undecided mixtures go."""
    return keep_determined(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near-duplicates (five-word shingles)."""
    return keep_one(docs, width=5, num=80, den=100)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 4096 tokens."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), 4096, 1)


STAGES = [("language_id", language), ("quality_rules", quality), ("near_dedup", near_dedup),
          ("secret_scan", secrets), ("packing", packing)]

#: No stage but the first few counts can be put in SQL; see tests/llm for the comparison.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
