"""The corpus build, end to end, as one DataFrame program.

labelled documents -> drop broken (B1) -> keep first copy (E1) -> strip
quotes (H1) -> decode entities (H2) -> [balance (E3) / shuffle (F1)] ->
clean (H12, H3-H11) -> words -> tags (N1) -> pre-processing (I1) -> split (E2)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions.escapes import decode_entities
from ..operators import sampling as S
from ..operators import tagging as T
from ..sources.tables import labelled_documents

DEFAULT_GROUPS = {"A": ["A"], "V": ["V"], "R": ["R"], "N": ["N"]}
DEFAULT_WEIGHTS = {"A": 4, "V": 2, "R": 1, "N": 1}


def filtered_corpus(docs: DataFrame, text: str = "text", dedupe_key: Column | None = None,
                    decode: bool = True) -> DataFrame:
    """B1 -> E1 -> H1 -> H2 (the reference's filter step) on any
    ``doc_id, text, label`` frame."""
    docs = S.drop_broken(docs, text)
    key = F.md5(F.col(text)) if dedupe_key is None else dedupe_key
    docs = S.dedupe_first(docs, key, "doc_id")
    docs = docs.withColumn(text, C.strip_quotes(text))
    if decode:
        docs = docs.withColumn(text, decode_entities(F.col(text)))
    return docs


def tokenised(docs: DataFrame, text: str = "text", groups: dict | None = None,
              stopwords=None, lexicon=None, spaced: bool = True) -> DataFrame:
    """clean -> words -> tokens (N1) -> terms."""
    docs = docs.withColumn("clean", C.clean_text(F.col(text), spaced))
    docs = docs.withColumn("words", C.words(F.col("clean")))
    docs = T.tag_words(docs, "words", "tokens", lexicon=lexicon)
    return T.preprocess(docs, groups or DEFAULT_GROUPS, stopwords=stopwords)


def build_corpus(spark: SparkSession, sf_dir: str, groups: dict | None = None,
                 balance: bool = False, shuffle: bool = False, seed: int = 42,
                 train: float = 0.7, test: float = 0.2, stopwords=None, lexicon=None,
                 decode: bool = True) -> DataFrame:
    """The prepared, split corpus: ``doc_id, label, pos, split, clean, words,
    tokens, terms`` (``pos`` = the document's position key).

    Variants: plain (doc order), ``shuffle`` (seeded order), ``balance``
    (equal classes, seeded order), as the reference's three corpora.
    """
    docs = labelled_documents(spark, sf_dir)
    docs = filtered_corpus(docs, decode=decode)
    if balance:
        docs = S.balance_classes(docs, "label", "doc_id", seed)
        shuffle = True
    if shuffle:
        docs = docs.withColumn("pos", S.shuffle_key("doc_id", seed))
    else:
        docs = docs.withColumn("pos", F.col("doc_id"))
    docs = S.split_by_position(docs, "pos", train, test)
    return tokenised(docs, "text", groups, stopwords, lexicon)
