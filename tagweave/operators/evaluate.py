"""Predictions and their metrics (C7, D13-D16, B7, E5) and a deterministic,
SQL-checkable classifier: nearest class centroid on the OCFS-kept,
POS-weighted L1 features -- for many weightings at once.

Metrics take any frame with ``label`` and ``prediction`` columns (the
MaxEnt model's output too).  All are single small aggregations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import LABELS
from ..session import cut_lineage
from . import longform as L
from .select import kth_smallest
from .tagging import weight_of

# the order the reference passes its three labels to the F1 function
REPORT_LABELS = ["neutral", "positive", "negative"]


# ---------------------------------------------------------------------------
# many weightings at once
# ---------------------------------------------------------------------------

def grid_values(docs: DataFrame, combos: list, terms: str = "terms") -> DataFrame:
    """POS-weighted L1 values of every (doc, term) pair under every weighting:
    ``combo_id, doc_id, label, split, word, grp, value``.  Per-document totals
    are computed in-row; rows = pairs x weightings."""
    if len(combos) > L.GRID_CHUNK:
        parts = [grid_values(docs, combos[i:i + L.GRID_CHUNK], terms).withColumn("combo_id", F.col("combo_id") + i)
                 for i in range(0, len(combos), L.GRID_CHUNK)]
        return reduce(DataFrame.unionByName, parts)
    d = L.with_counts(docs, terms)
    totals = F.array(*[F.aggregate("counts", F.lit(0.0), L._weighted_sum(w))
                       for w in combos])
    d = d.withColumn("_tot", totals)
    ex = L.explode_rows(d, ["doc_id", "label", "split", "_tot"], "counts")
    vals = F.array(*[F.when(F.col("_tot")[i] > 0, F.col("t.cnt") * weight_of(F.col("t.grp"), w) / F.col("_tot")[i])
                     .otherwise(F.lit(0.0)) for i, w in enumerate(combos)])
    return ex.select("doc_id", "label", "split", F.col("t.word").alias("word"), F.col("t.grp").alias("grp"),
                     F.posexplode(vals).alias("combo_id", "value"))


def centroid_scores(values: DataFrame, sizes: dict) -> DataFrame:
    """Per (combo, feature): exact class sums and the OCFS score (one
    aggregation).  Callers persist it and cut it at several settings."""
    classes = sorted(sizes)
    v = F.col("value").cast(L.EXACT)
    aggs = [F.sum(F.when(F.col("label") == F.lit(c), v)).alias(f"_s{i}") for i, c in enumerate(classes)]
    sums = values.where(F.col("split") == "train").groupBy("combo_id", *L.TERM).agg(*aggs)
    return L.ocfs_from_sums(sums, classes, sizes, ["combo_id"] + L.TERM + [f"_s{i}" for i in range(len(classes))])


def centroid_cut(scored: DataFrame, sizes: dict, n_delete: int) -> DataFrame:
    """Kept flag and class means per (combo, feature) for one feature-cut
    setting; the per-combo cut comes from ``kth_smallest`` grouped by combo."""
    classes = sorted(sizes)
    counts = {r["combo_id"]: r["n"] for r in scored.groupBy("combo_id").agg(F.count("*").alias("n")).collect()}
    cuts = {}
    for cid, p in counts.items():
        q = L.percentile_rank(n_delete, p) / 100.0
        h = q * (p - 1)
        lo_i, hi_i = int(h // 1), int(-(-h // 1))
        cuts[cid] = (lo_i, hi_i, h)
    lo = kth_smallest(scored, "score", {str(c): v[0] + 1 for c, v in cuts.items()}, group="combo_id")
    hi = kth_smallest(scored, "score", {str(c): v[1] + 1 for c, v in cuts.items()}, group="combo_id")
    cut_of = {}
    for cid, (lo_i, hi_i, h) in cuts.items():
        a, b = lo[str(cid)], hi[str(cid)]
        cut_of[cid] = a if a == b else a + (b - a) * (h - lo_i)
    items = []
    for cid, c in cut_of.items():
        items += [F.lit(cid), F.lit(float(c))]
    cut = F.try_element_at(F.create_map(*items), F.col("combo_id"))
    means = [(F.coalesce(F.col(f"_s{i}"), F.lit(0)).cast("double") / F.lit(float(sizes[c]))).alias(f"m_{i}")
             for i, c in enumerate(classes)]
    return scored.select("combo_id", *L.TERM, "score", cut.alias("cut"), (F.col("score") >= cut).alias("kept"), *means)


def centroid_model(values: DataFrame, sizes: dict, n_delete: int, n_combos: int) -> DataFrame:
    """Per (combo, feature): OCFS score, kept flag and class means (one
    ``m_<i>`` column per class, classes sorted)."""
    return centroid_cut(centroid_scores(values, sizes).persist(), sizes, n_delete)


def centroid_predict(values: DataFrame, docs: DataFrame, model: DataFrame, classes: list,
                     n_combos: int) -> DataFrame:
    """Nearest class centroid over the kept features, per (combo, doc):
    argmin_c ||m_c||^2 - 2 x.m_c (||x||^2 is the same for every class).
    Distances are rounded to 9 places before the argmin and ties go to the
    alphabetically first class, so the result is engine-independent."""
    kept = model.where("kept")
    k = len(classes)
    norms = {(r["combo_id"], i): r[f"n_{i}"] or 0.0 for r in kept.groupBy("combo_id").agg(
        *[F.sum(F.col(f"m_{i}") * F.col(f"m_{i}")).alias(f"n_{i}") for i in range(k)]).collect() for i in range(k)}
    dots = (values.join(kept.select("combo_id", *L.TERM, *[f"m_{i}" for i in range(k)]), ["combo_id"] + L.TERM)
            .groupBy("combo_id", "doc_id")
            .agg(*[F.sum(F.col("value") * F.col(f"m_{i}")).alias(f"d_{i}") for i in range(k)]))
    base = docs.select("doc_id", "label", "split",
                       F.explode(F.sequence(F.lit(0), F.lit(n_combos - 1))).alias("combo_id"))
    j = base.join(dots, ["combo_id", "doc_id"], "left")

    def norm(i):
        items = []
        for c in range(n_combos):
            items += [F.lit(c), F.lit(float(norms.get((c, i), 0.0)))]
        return F.try_element_at(F.create_map(*items), F.col("combo_id"))

    dist = [F.struct(F.round(norm(i) - 2.0 * F.coalesce(F.col(f"d_{i}"), F.lit(0.0)), 9).alias("d"),
                     F.lit(c).alias("c")) for i, c in enumerate(classes)]
    return j.select("combo_id", "doc_id", "label", "split", F.array_min(F.array(*dist))["c"].alias("prediction"))


# ---------------------------------------------------------------------------
# metrics
# ---------------------------------------------------------------------------

def confusion(pred: DataFrame) -> DataFrame:
    """Counts per (gold, predicted) label."""
    return pred.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def accuracy(pred: DataFrame, by: list | None = None) -> DataFrame:
    """Share of correct predictions."""
    ok = F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy")
    return pred.groupBy(*(by or [])).agg(ok)


def per_class(pred: DataFrame, labels=None, by: list | None = None) -> DataFrame:
    """Precision, recall, F1 and support for each label of a fixed list
    (0/0 counts as 0, like the reference's library)."""
    labels = labels or LABELS
    by = by or []
    rows = []
    for lab in labels:
        tp = F.sum(((F.col("label") == lab) & (F.col("prediction") == lab)).cast("long"))
        pp = F.sum((F.col("prediction") == lab).cast("long"))
        sup = F.sum((F.col("label") == lab).cast("long"))
        rows.append(F.struct(F.lit(lab).alias("class"), tp.alias("tp"), pp.alias("pp"), sup.alias("support")))
    agg = pred.groupBy(*by).agg(F.array(*rows).alias("_r"))
    ex = agg.select(*by, F.explode("_r").alias("r")).select(*by, "r.*")
    return _prf(ex, by)


def _prf(ex: DataFrame, by: list | None = None) -> DataFrame:
    """Precision, recall and F1 from ``class, tp, pp, support``."""
    prec = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return ex.select(*(by or []), "class", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), "support")


def _per_class_of(cm: DataFrame, labels: list) -> DataFrame:
    """D14 from a confusion frame ``label, prediction, n``."""
    rows = []
    for lab in labels:
        gold, said = F.col("label") == lab, F.col("prediction") == lab
        cell = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
        rows.append(F.struct(F.lit(lab).alias("class"), cell(gold & said).alias("tp"), cell(said).alias("pp"),
                             cell(gold).alias("support")))
    ex = cm.agg(F.array(*rows).alias("_r")).select(F.explode("_r").alias("r")).select("r.*")
    return _prf(ex)


def macro_f1(pred: DataFrame, labels=None, by: list | None = None) -> DataFrame:
    """Mean F1 over the fixed label list."""
    by = by or []
    return per_class(pred, labels or REPORT_LABELS, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def classification_report(pred: DataFrame, labels=None) -> DataFrame:
    """One row per class plus micro, macro and weighted averages, all
    derived from one confusion aggregate (at most labels^2 rows), so the
    predictions are computed once."""
    labels = labels or LABELS
    cm = cut_lineage(confusion(pred))
    pc = _per_class_of(cm, labels)
    total = F.sum("support")
    right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    acc = cm.agg((right / F.sum("n")).alias("a"), F.sum(F.when(F.col("label").isin(labels), F.col("n")).otherwise(0))
                 .alias("support"))
    micro = acc.select(F.lit("micro avg").alias("class"), F.col("a").alias("precision"), F.col("a").alias("recall"),
                       F.col("a").alias("f1"), "support")
    macro = pc.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total.alias("support"))
    weighted = pc.agg(F.lit("weighted avg").alias("class"),
                      (F.sum(F.col("precision") * F.col("support")) / total).alias("precision"),
                      (F.sum(F.col("recall") * F.col("support")) / total).alias("recall"),
                      (F.sum(F.col("f1") * F.col("support")) / total).alias("f1"), total.alias("support"))
    return pc.unionByName(micro).unionByName(macro).unionByName(weighted)


def wrong_predictions(pred: DataFrame, n: int, gold: str | None = None, order: str = "doc_id") -> DataFrame:
    """B7 + E5: the first ``n`` misclassified documents per gold label (or of
    one gold label), in document order.  ``n = 0`` returns nothing.

    ``row_number() <= n`` over a partition is planned with a per-task group
    limit before the shuffle, so a label with a third of the rows still
    sends at most n rows per task."""
    wrong = pred.where(F.col("label") != F.col("prediction"))
    if gold is not None:
        wrong = wrong.where(F.col("label") == gold)
    if n <= 0:
        return wrong.limit(0).withColumn("rank", F.lit(0))
    w = Window.partitionBy("label").orderBy(order)
    return wrong.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
