"""Splits, balancing, shuffles, ranges, de-duplication, order statistics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tagweave.operators import sampling as S
from tagweave.operators.select import kth_smallest


def test_split_points_published():
    assert S.split_points(34452) == (24116, 27561)
    n = 34452
    tr, ts = S.split_points(n)
    assert (tr, n - ts, ts - tr) == (24116, 6891, 3445)


def test_split_partition(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "doc_id").withColumn("doc_id", F.col("doc_id") * 7 + 3)
    out = S.split_by_position(df, "doc_id")
    c = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert c == {"train": 700, "dev": 100, "test": 200}
    assert out.where("split = 'train'").agg(F.max("doc_id")).first()[0] < out.where("split = 'dev'").agg(F.min("doc_id")).first()[0]


def test_kth_smallest_matches_sort(spark):
    random.seed(1)
    vals = [random.randint(-10**12, 10**12) for _ in range(3000)] + [5] * 500
    df = spark.createDataFrame([(v, "a" if i % 3 else "b") for i, v in enumerate(vals)], "v long, g string")
    for k in (1, 17, 1500, 3500):
        assert kth_smallest(df, "v", k, buckets=8, max_collect=50)[None] == sorted(vals)[k - 1]
    by = kth_smallest(df, "v", 10, group="g", buckets=4, max_collect=20)
    for g in ("a", "b"):
        sub = sorted(v for i, v in enumerate(vals) if ("a" if i % 3 else "b") == g)
        assert by[g] == sub[9]


def test_balance_classes(spark):
    rows = [(i, "pos" if i % 5 else "neg") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, label string")
    out = S.balance_classes(df)
    c = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert c == {"pos": 100, "neg": 100}
    # same seed, same rows
    assert sorted(r[0] for r in out.collect()) == sorted(r[0] for r in S.balance_classes(df).collect())


def test_shuffled_index_is_a_permutation(spark):
    df = spark.range(0, 300).withColumnRenamed("id", "doc_id")
    idx = [r["row_index"] for r in S.shuffled(df).collect()]
    assert sorted(idx) == list(range(300))


def test_row_range_rules(spark):
    df = spark.range(0, 50).withColumnRenamed("id", "doc_id")
    assert S.row_range(df, "doc_id", 10, 20).count() == 10
    assert S.row_range(df, "doc_id", None, None).count() == 50
    assert S.row_range(df, "doc_id", 30, 20).count() == 0


def test_dedupe_keeps_first(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "doc_id long, text string")
    assert sorted(r[0] for r in S.dedupe_first(df, "text").collect()) == [1, 2]
