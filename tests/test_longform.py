"""Long-form features: golden OCFS case and agreement with the ML path."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.operators import longform as L

DOCS = [
    (0, "positive", "train", [("good", "A"), ("good", "A"), ("dog", "N")]),
    (1, "negative", "train", [("bad", "A"), ("dog", "N")]),
    (2, "neutral", "train", [("dog", "N"), ("the", "DEFAULT")]),
]
SCHEMA = "doc_id long, label string, split string, terms array<struct<word:string,grp:string>>"
W = {"A": 4, "N": 1}


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


def test_pos_weighted_rows(docs):
    v = {(r["doc_id"], r["word"]): r["value"] for r in L.pos_weighted(docs, W).collect()}
    assert v[(0, "good")] == pytest.approx(8 / 9) and v[(0, "dog")] == pytest.approx(1 / 9)
    assert v[(1, "bad")] == pytest.approx(0.8) and v[(2, "the")] == 0.0 and v[(2, "dog")] == 1.0


def test_ocfs_golden(docs):
    sizes = L.class_sizes(docs)
    scores = {r["word"]: r["score"] for r in L.ocfs_scores(L.pos_weighted(docs, W), sizes).collect()}
    assert scores["good"] == pytest.approx(175.5829904)
    assert scores["dog"] == pytest.approx(159.78052126)
    assert scores["bad"] == pytest.approx(142.22222222)
    assert scores["the"] == 0.0


def test_ocfs_cut_and_keep(docs):
    sizes = L.class_sizes(docs)
    sc = L.ocfs_scores(L.pos_weighted(docs, W), sizes)
    assert L.ocfs_cut(sc, 2) == pytest.approx(151.00137174)
    kept = {r["word"] for r in L.ocfs_keep(sc, 2).where("kept").collect()}
    assert kept == {"good", "dog"}


def test_idf(spark):
    d = spark.createDataFrame([(0, "x", "train", [("a", "G"), ("b", "G"), ("a", "G")]),
                               (1, "x", "train", [("b", "G"), ("c", "G")]),
                               (2, "x", "train", [("b", "G")])], SCHEMA)
    got = {r["word"]: r["idf"] for r in L.idf(d).collect()}
    assert got["a"] == pytest.approx(1.69314718) and got["c"] == pytest.approx(1.69314718)
    assert got["b"] == pytest.approx(1.0)


def test_percentile_rank_and_linear(spark):
    assert L.percentile_rank(2, 4) == 50
    assert L.percentile_rank(10, 4) == 100
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "v double")
    assert L.linear_percentile(df, "v", 0.37) == pytest.approx(2.22)


def test_counts_match_python(spark, docs):
    got = sorted((r["doc_id"], r["word"], r["cnt"]) for r in L.term_counts(docs).collect())
    assert got == [(0, "dog", 1), (0, "good", 2), (1, "bad", 1), (1, "dog", 1), (2, "dog", 1), (2, "the", 1)]


def test_ml_path_agrees_with_long_form(spark, docs):
    """OCFS from Summarizer class means == OCFS from the grouped long form."""
    from tagweave.operators.features import FusedFeatures, ocfs_mask
    ff = FusedFeatures(docs)
    x = ff.cv.transform(ff.keys.transform(docs))
    for st in ff.pos_stages(W):
        x = st.transform(x)
    scores, mask = ocfs_mask(x, "pos_l1", "label", 2)
    by_key = dict(zip(ff.vocabulary, scores))
    assert by_key["A\u001fgood"] == pytest.approx(175.5829904)
    assert by_key["N\u001fdog"] == pytest.approx(159.78052126)
    assert sorted(k for k, m in zip(ff.vocabulary, mask) if m) == ["A\u001fgood", "N\u001fdog"]


def test_estimators_agree_with_long_form(spark, docs):
    """I4 and I5 as Estimators, saved and loaded, against the long form."""
    from tagweave.operators.features import OCFSSelector, PosWeightedVectorizer, keys_stage
    keyed = keys_stage().transform(docs)
    vectorizer = PosWeightedVectorizer(inputCol="term_keys", outputCol="pos", weights='{"A": 4, "N": 1}').fit(keyed)
    vocabulary = vectorizer.stages[0].vocabulary
    rows = vectorizer.transform(keyed)
    got = {(r["doc_id"], vocabulary[i]): v for r in rows.collect() for i, v in enumerate(r["pos"].toArray()) if v}
    values = L.pos_weighted(docs, W)
    want = {(r["doc_id"], f"{r['grp']}\u001f{r['word']}"): r["value"] for r in values.collect() if r["value"]}
    assert got == pytest.approx(want)
    selected = OCFSSelector(inputCol="pos", outputCol="sel", labelCol="label", numToDelete=2).fit(rows).transform(rows)
    kept = {vocabulary[i] for r in selected.collect() for i, v in enumerate(r["sel"].toArray()) if v}
    long = L.ocfs_keep(L.ocfs_scores(values, L.class_sizes(docs)), 2).where("kept").collect()
    assert kept == {f"{r['grp']}\u001f{r['word']}" for r in long}
