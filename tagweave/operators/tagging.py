"""Token tagging and tagged-document pre-processing.

Documents carry their tokens as ``ARRAY<STRUCT<word, tag>>`` and their
pre-processed terms as ``ARRAY<STRUCT<word, grp>>``.  Everything here is a
higher-order function on those arrays: per row, JVM-side, no shuffle.
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..session import cut_lineage

DEFAULT_GROUP = "DEFAULT"


def rule_tag(word: Column, rules=None, default: str = P.DEFAULT_TAG) -> Column:
    """N1 rules: first matching pattern wins, else ``default``."""
    rules = P.TAG_RULES if rules is None else rules
    expr = None
    for tag, pat in rules:
        expr = F.when(word.rlike(pat), F.lit(tag)) if expr is None else expr.when(word.rlike(pat), F.lit(tag))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def tag_words(df: DataFrame, words: str = "words", out: str = "tokens", lexicon=None,
              rules=None) -> DataFrame:
    """``words ARRAY<STRING>`` -> ``tokens ARRAY<STRUCT<word, tag>>``.

    ``lexicon`` (word -> tag; a dict or a two-column DataFrame) wins over the
    rules.  It is joined on the word whatever its size (Spark broadcasts a
    small one); of several tags for a word the alphabetically first counts.
    Documents need no unique key: rows are numbered where they lie and
    written once, so equal texts, however many, stay spread over the tasks.
    Each distinct word of a document is joined once.
    """
    if lexicon is None:
        return df.withColumn(out, F.transform(F.col(words), lambda w: F.struct(
            w.alias("word"), rule_tag(w, rules).alias("tag"))))
    spark = df.sparkSession
    if isinstance(lexicon, dict):
        lexicon = spark.createDataFrame(list(lexicon.items()), "word string, tag string")
    lex = (lexicon.toDF("word", "_lex_tag").where("word is not null and _lex_tag is not null")
           .groupBy("word").agg(F.min("_lex_tag").alias("_lex_tag")))
    keyed = cut_lineage(df.withColumn("_doc", F.monotonically_increasing_id()))
    ex = keyed.select("_doc", F.explode(F.array_distinct(words)).alias("word"))
    found = ex.join(lex, "word").groupBy("_doc").agg(F.map_from_entries(F.collect_list(F.struct("word", "_lex_tag"))).alias("_lex"))
    tagged = keyed.join(found, "_doc", "left").withColumn(out, F.transform(F.col(words), lambda w: F.struct(
        w.alias("word"), F.coalesce(F.try_element_at(F.col("_lex"), w), rule_tag(w, rules)).alias("tag"))))
    return tagged.drop("_doc", "_lex")


def group_of(tag: Column, groups: dict, default: str = DEFAULT_GROUP) -> Column:
    """The first group (declaration order) whose tag list holds ``tag``."""
    expr = None
    for name, tags in groups.items():
        if not tags:
            continue
        cond = tag.isin(list(tags))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def weight_of(grp: Column, weights: dict) -> Column:
    """C4: weight of a group, 0 when the group has none."""
    if not weights:
        return F.lit(0.0)
    items = []
    for k, v in weights.items():
        items += [F.lit(k), F.lit(float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*items), grp), F.lit(0.0))


def preprocess(df: DataFrame, groups: dict | None = None, default: str = DEFAULT_GROUP,
               stopwords=None, to_lower: bool = True, tokens: str = "tokens",
               out: str = "terms") -> DataFrame:
    """I1 = H14 (lower) + B4/C2 (stopwords) + C3 (grouping).

    A document whose tokens are all stopwords keeps an empty array.
    """
    groups = OrderedDict(groups or {"V": ["V"], "A": ["A"], "N": ["N"], "R": ["R"]})
    stop = list(P.ENGLISH_STOPWORDS if stopwords is None else stopwords)
    word = (lambda t: F.lower(t["word"])) if to_lower else (lambda t: t["word"])
    kept = F.filter(F.col(tokens), lambda t: ~word(t).isin(stop)) if stop else F.col(tokens)
    return df.withColumn(out, F.transform(kept, lambda t: F.struct(
        word(t).alias("word"), group_of(t["tag"], groups, default).alias("grp"))))


def remove_stopwords(words: Column, stopwords=None) -> Column:
    """B4 on a plain word array."""
    stop = list(P.ENGLISH_STOPWORDS if stopwords is None else stopwords)
    return F.filter(words, lambda w: ~w.isin(stop))


def tag_statistics(docs: DataFrame, tokens: str = "tokens", by: str = "label") -> DataFrame:
    """Tokens, distinct words and documents per (label, tag), with the
    tag's description and family from the tagset dimension."""
    # Two passes read the tokens, so what makes them runs once.
    docs = cut_lineage(docs.select("doc_id", by, tokens))
    ex = docs.select(by, F.explode_outer(tokens).alias("t")).where(F.col("t").isNotNull()).select(
        by, F.col("t.word").alias("word"), F.col("t.tag").alias("tag"))
    # Distinct counts as two levels of plain counts: no row is expanded once per distinct column.
    words = ex.groupBy(by, "tag", "word").agg(F.count("*").alias("n")).groupBy(by, "tag").agg(
        F.sum("n").alias("n_tokens"), F.count("word").alias("n_types"), F.lit(0).cast("long").alias("n_docs"))
    tags = F.explode_outer(F.array_distinct(F.transform(F.col(tokens), lambda t: t["tag"])))
    nothing = F.lit(0).cast("long")
    in_docs = docs.where(F.size(tokens) > 0).select("doc_id", by, tags.alias("tag")).distinct().groupBy(by, "tag").agg(
        nothing.alias("n_tokens"), nothing.alias("n_types"), F.count("doc_id").alias("n_docs"))
    stats = words.unionByName(in_docs).groupBy(by, "tag").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum("n_types").alias("n_types"), F.sum("n_docs").alias("n_docs"))
    spark = docs.sparkSession
    dim = spark.createDataFrame(P.TAGSET, "tag string, description string, family string")
    # the tagset dimension has a fixed size (25 rows): safe to broadcast
    return stats.join(F.broadcast(dim), "tag", "left")
