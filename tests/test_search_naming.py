"""Weight grid, names, report arithmetic."""

import pytest
from pyspark.sql import functions as F

from tagweave.functions import naming as NM
from tagweave.operators import evaluate as V
from tagweave.operators.search import weight_grid


def test_grid_order_and_gcd():
    assert [tuple(w.values()) for w in weight_grid({"V": 1, "A": 1}, 2, canonical=False)] == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert [tuple(w.values()) for w in weight_grid({"V": 1, "A": 1}, 2)] == [(1, 1), (1, 2), (2, 1)]
    assert len(weight_grid({k: 1 for k in "ABCD"}, 5)) == 607
    assert len(weight_grid({k: 1 for k in "ABCD"}, 4)) == 239
    assert len(weight_grid({"A": 1}, 5)) == 1


def test_run_and_model_names(spark):
    assert NM.run_name({"A+E": ["A", "E"]}, 1, 0, {"bow": 0.7, "pos": 0.3}, 0.7, 0.2) == \
        "A-E_scale_1_del_0_bow_0.7_pos_0.3_train_0.7_test_0.2"
    assert NM.model_name({"R": 1, "E": 2, "A": 4, "!": 4}, 35000, {"bow": 0.5, "pos": 0.5}, 0.7) == \
        "!4_A4_E2_R1_35000_bow_0.5_pos_0.5_0.7"
    df = spark.range(1).select(
        NM.run_name_col(F.create_map(F.lit("A+E"), F.array(F.lit("A"), F.lit("E"))), F.lit(1), F.lit(0),
                        F.create_map(F.lit("pos"), F.lit(0.3), F.lit("bow"), F.lit(0.7)), F.lit(0.7), F.lit(0.2)),
        NM.model_name_col(F.create_map(F.lit("R"), F.lit(1), F.lit("E"), F.lit(2), F.lit("A"), F.lit(4), F.lit("!"), F.lit(4)),
                          F.lit(35000), F.create_map(F.lit("bow"), F.lit(0.5), F.lit("pos"), F.lit(0.5)), F.lit(0.7)))
    r = df.first()
    assert r[0] == "A-E_scale_1_del_0_bow_0.7_pos_0.3_train_0.7_test_0.2"
    assert r[1] == "!4_A4_E2_R1_35000_bow_0.5_pos_0.5_0.7"


def test_report_arithmetic(spark):
    pred = spark.createDataFrame(
        [("positive", "positive")] * 8 + [("positive", "negative")] * 2 + [("negative", "negative")] * 5 +
        [("neutral", "positive")] * 3 + [("neutral", "neutral")] * 2, "label string, prediction string")
    rep = {r["class"]: r for r in V.classification_report(pred).collect()}
    f1s = [rep[c]["f1"] for c in ("negative", "neutral", "positive")]
    assert rep["macro avg"]["f1"] == pytest.approx(sum(f1s) / 3)
    assert rep["micro avg"]["precision"] == pytest.approx(15 / 20)
    sup = [rep[c]["support"] for c in ("negative", "neutral", "positive")]
    assert rep["weighted avg"]["f1"] == pytest.approx(sum(f * s for f, s in zip(f1s, sup)) / sum(sup))
    mf = V.macro_f1(pred).first()["macro_f1"]
    assert mf == pytest.approx(sum(f1s) / 3)


def test_wrong_predictions_zero_is_empty(spark):
    pred = spark.createDataFrame([(1, "a", "b")], "doc_id long, label string, prediction string")
    assert V.wrong_predictions(pred, 0).count() == 0
    assert V.wrong_predictions(pred, 3).count() == 1


def test_scores_spread_to_the_whole_grid():
    from tagweave.operators import search as R
    groups = {"A": ["A"], "V": ["V"]}
    canonical = [{"combo_id": i, "weights": R.weights_label(w), "test_acc": i / 10} for i, w in enumerate(R.weight_grid(groups, 3))]
    full = R.spread_to_grid(canonical, groups, 3)
    assert [r["weights"] for r in full] == [R.weights_label(w) for w in R.weight_grid(groups, 3, canonical=False)]
    score = {r["weights"]: r["test_acc"] for r in full}
    assert len(full) == 9 and score["A:1,V:1"] == score["A:2,V:2"] == score["A:3,V:3"]


def test_kth_smallest_on_neighbouring_large_integers(spark):
    from tagweave.operators.select import kth_smallest
    big = 1 << 60
    df = spark.createDataFrame([(big + i % 2,) for i in range(6)] + [(-big,), (2 ** 63 - 1,)], "v long")
    ordered = sorted([big + i % 2 for i in range(6)] + [-big, 2 ** 63 - 1])
    assert [kth_smallest(df, "v", k, max_collect=1)[None] for k in (1, 2, 5, 8)] == [ordered[k - 1] for k in (1, 2, 5, 8)]


def test_grids_beyond_one_chunk(spark, monkeypatch):
    from tagweave.operators import evaluate as V
    from tagweave.operators import longform as L
    docs = spark.createDataFrame([(1, "x", "train", [("a", "A"), ("b", "V")]), (2, "y", "train", [("a", "V")])],
                                 "doc_id long, label string, split string, terms array<struct<word:string,grp:string>>")
    combos = [{"A": a, "V": v} for a in range(1, 4) for v in range(1, 4)]
    whole = sorted(map(tuple, V.grid_values(docs, combos).collect()))
    scores = sorted(map(tuple, L.ocfs_grid(docs, combos, {"x": 1, "y": 1}).collect()))
    monkeypatch.setattr(L, "GRID_CHUNK", 4)
    assert sorted(map(tuple, V.grid_values(docs, combos).collect())) == whole
    assert sorted(map(tuple, L.ocfs_grid(docs, combos, {"x": 1, "y": 1}).collect())) == scores


def test_registered_maxent_search_covers_the_reference_grid(spark, monkeypatch):
    from tagweave.operators import grid_fit as G
    from tagweave.operators import search as R
    from tagweave.operators import solver
    from tagweave.plans import queries as Q
    fitted, starts_of = [], []

    class Recorded:
        groups = sorted(Q.GROUPS)
        labels = ["negative", "neutral", "positive"]

        def __init__(self, *args, **kwargs):
            pass

        def lanes(self):
            return 64

        def fit(self, combos, starts=None):
            fitted.extend(tuple(w.values()) for w in combos)
            starts_of.append(starts)
            return [solver.Optimum(w, [0.0], True) for w in combos], [w["R"] / 10 for w in combos]

        def close(self):
            pass

    frames = spark.range(1), spark.range(1)
    monkeypatch.setattr(Q, "_splits", lambda *a: frames)
    monkeypatch.setattr(G, "GridFit", Recorded)
    monkeypatch.setattr(G, "_run_scores", lambda counts, labels: (0.5, counts, 0.5))
    rows = {r["weights"]: r for r in Q.QUERIES["grid_search"](spark, "").collect()}
    assert len(set(fitted)) == 607 and len(rows) == 625
    # the first weighting alone, then every one once, each from the optimum of one solved before
    assert len(fitted) == 608 and starts_of[0] is None and all(len(s) for s in starts_of[1:])
    for w in weight_grid(Q.GROUPS, 5, canonical=False):
        assert R.weights_label(w) in rows
    three = R.weights_label({**dict.fromkeys(Q.GROUPS, 1), "A": 5, "V": 5, "R": 3})
    assert rows[three]["test_acc"] == 0.3
