"""All weightings scored together against one weighting after the other."""

import pytest
from pyspark.sql import functions as F

from tagweave.operators import evaluate as V
from tagweave.operators import longform as L
from tagweave.operators import weightings as W

GROUPS = ["A", "V", "N"]
COMBOS = [{"A": 1, "V": 1, "N": 1}, {"A": 5, "V": 1, "N": 2}, {"A": 1, "V": 4, "N": 3}, {"A": 0, "V": 0, "N": 1}, {"V": 2}]


@pytest.fixture(scope="module")
def docs(spark):
    words = ["good", "bad", "fine", "dull", "film", "plot", "star", "the"]
    rows = []
    for i in range(60):
        terms = [(words[(i * k + k * k) % 8], "AVNX"[(i + k * (i % 3)) % 4]) for k in range(1, 4 + i % 7)]
        terms += [(f"only{i}", "N")] if i % 4 == 0 else []
        split = "train" if i < 40 else "dev" if i < 46 else "test"
        rows.append((i, ["negative", "neutral", "positive"][(i * 7 + i // 5) % 3], split, terms if i % 11 else []))
    df = spark.createDataFrame(rows, "doc_id long, label string, split string, terms array<struct<word:string,grp:string>>")
    return df.persist()


@pytest.fixture(params=[{}, {"HOT_ROWS": 6, "STEP": 7, "LANES": 3, "BUCKETS": 64}], ids=["one pass", "parts and passes"])
def setting(request, monkeypatch):
    for name, value in request.param.items():
        monkeypatch.setattr(W, name, value)


@pytest.mark.parametrize("n_delete", [0, 7])
def test_runs_equal_the_scorer_of_single_weightings(docs, setting, n_delete):
    sizes = L.class_sizes(docs)
    got = {r["combo_id"]: tuple(r)[2:] for r in W.grid_runs(docs, COMBOS, GROUPS, sizes, [n_delete]).collect()}
    values = V.grid_values(docs, COMBOS)
    pred = V.centroid_predict(values, docs, V.centroid_model(values, sizes, n_delete, len(COMBOS)), sorted(sizes), len(COMBOS))
    acc = {(r["combo_id"], r["split"]): r["accuracy"] for r in V.accuracy(pred, ["combo_id", "split"]).collect()}
    f1 = {r["combo_id"]: r["macro_f1"] for r in V.macro_f1(pred.where("split = 'test'"), by=["combo_id"]).collect()}
    want = {i: (acc[i, "train"], acc[i, "test"], f1[i]) for i in range(len(COMBOS))}
    assert set(got) == set(want)
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-12)


def test_best_terms_and_feature_counts(docs, setting):
    sizes = L.class_sizes(docs)
    got, counts = {}, {}
    for at, w in W.in_passes(docs, COMBOS, GROUPS, sizes):
        for r in w.top_terms(4).collect():
            got[r["combo_id"] + at, r["rank"]] = (r["word"], r["grp"], round(r["score"], 6))
        for r in w.feature_counts(w.cuts(7)).collect():
            counts[r["combo_id"] + at] = (r["n_features"], r["n_kept"])
    scores = L.ocfs_grid(docs, COMBOS, sizes)
    want = {}
    for i in range(len(COMBOS)):
        rows = [(round(r["score"], 6), r["word"], r["grp"]) for r in scores.where(F.col("combo_id") == i).collect()]
        for k, (s, word, grp) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1], x[2]))[:4]):
            want[i, k + 1] = (word, grp, s)
        one = scores.where(F.col("combo_id") == i).select("word", "grp", "score")
        kept = L.ocfs_keep(one, 7)
        assert counts[i] == (one.count(), kept.where("kept").count())
    assert got == want


def test_an_empty_corpus_has_no_terms(spark):
    docs = spark.createDataFrame([(1, "negative", "train", [])],
                                 "doc_id long, label string, split string, terms array<struct<word:string,grp:string>>")
    w = W.Weightings(docs, COMBOS, GROUPS, {"negative": 1})
    assert w.top_terms(3).count() == 0
    with pytest.raises(ValueError):
        w.cuts(3)
