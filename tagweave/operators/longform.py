"""Feature statistics in long form: ``(doc_id, word, grp, value)`` rows.

D4 vocabulary, D5 term counts, D6/D7 POS-weighted L1 values, D8 IDF, I3/H20
TF-IDF, I2 binary BoW, D9/D10 centroids, D11 OCFS scores, D12 cut-off,
F4/B6 keep-list, B5/C5 vocabulary filter, C6 many weightings at once,
G4 weighted block union.

Plan shape:
* per-document work (counting a document's terms, its weight total, its
  norms) happens inside the row on the ``terms`` array -- sort, then count
  runs -- so it needs no shuffle by document at all;
* corpus statistics (document frequency, class sums) are one ``groupBy`` on
  the exploded (doc, term) pairs with map-side partial aggregation;
* OCFS class sums are conditional sums per class in that same single
  aggregation, so no class x term grid (cross join) is ever built.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import kth_smallest
from .tagging import weight_of

TERM = ["word", "grp"]
EXACT = "decimal(38,18)"    # order-independent sums (see ocfs_scores)
MAX_CLASSES = 1000
GRID_CHUNK = 64             # weightings whose values ride in one row


# --------------------------------------------------------------------------
# per-document, in-row
# --------------------------------------------------------------------------

def _weighted_sum(w: dict):
    """Merge function sum(cnt * weight(grp)) for ``F.aggregate`` (a factory:
    PySpark would take a defaulted lambda argument for a lambda variable)."""
    return lambda acc, t: acc + t["cnt"] * weight_of(t["grp"], w)


def with_counts(docs: DataFrame, terms: str = "terms", out: str = "counts") -> DataFrame:
    """D5 in-row: ``ARRAY<STRUCT<word, grp>>`` -> ``ARRAY<STRUCT<word, grp, cnt>>``
    (one entry per distinct term, sorted): sort the array, find where runs of
    equal terms start, the run lengths are the counts.  O(n log n) per
    document, no shuffle.

    The sorted array and the run starts are materialised as columns first:
    Spark re-evaluates an expression captured inside a lambda for every
    element, which would make this quadratic.
    """
    d = docs.withColumn("_srt", F.array_sort(F.col(terms)))
    s = F.col("_srt")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))),
                      lambda i: (i <= F.size(s)) & ((i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1))))))
    d = d.withColumn("_st", starts)
    st = F.col("_st")
    ends = F.concat(F.slice(st, 2, F.greatest(F.size(st), F.lit(1))), F.array(F.size(s) + 1))
    counted = F.zip_with(st, ends, lambda a, b: F.struct(
        F.element_at(s, a)["word"].alias("word"), F.element_at(s, a)["grp"].alias("grp"),
        (b - a).cast("long").alias("cnt")))
    empty = F.array().cast("array<struct<word:string,grp:string,cnt:bigint>>")
    return (d.withColumn(out, F.when(F.size(s) > 0, counted).otherwise(empty))
            .drop("_srt", "_st"))


def explode_rows(df: DataFrame, keep: list, arr, alias: str = "t") -> DataFrame:
    """``explode`` without Catalyst's inferred ``size(arr) > 0`` filter.

    For a plain ``explode`` the optimizer adds that filter and pushes it
    below the projections that build ``arr``, inlining (and so recomputing)
    the whole array expression; ``explode_outer`` + a null filter keeps the
    array computed once.
    """
    a = F.col(arr) if isinstance(arr, str) else arr
    return df.select(*keep, F.explode_outer(a).alias(alias)).where(F.col(alias).isNotNull())


def exploded_counts(docs: DataFrame, keep: list) -> DataFrame:
    """``keep`` columns and ``word, grp, cnt`` rows of a ``counts`` column."""
    return (explode_rows(docs, keep, "counts")
            .select(*keep, F.col("t.word").alias("word"), F.col("t.grp").alias("grp"),
                    F.col("t.cnt").alias("cnt")))


def _keep_cols(docs: DataFrame) -> list:
    return [c for c in ("doc_id", "label", "split") if c in docs.columns]


def term_counts(docs: DataFrame, terms: str = "terms") -> DataFrame:
    """``doc_id, [label, split], word, grp, cnt`` -- no shuffle."""
    return exploded_counts(with_counts(docs, terms), _keep_cols(docs))


def pos_weighted(docs: DataFrame, weights: dict, terms: str = "terms") -> DataFrame:
    """D6 + D7 + C4: per (doc, term) ``cnt * w(grp)`` divided by the document's
    total; an all-zero document stays zero.  Zero-weight terms are kept (the
    reference stores them).  No shuffle."""
    return weighted_counts(with_counts(docs, terms), weights)


def weighted_counts(docs: DataFrame, weights: dict) -> DataFrame:
    """``pos_weighted`` of documents that have their ``counts``."""
    total = F.aggregate("counts", F.lit(0.0), lambda acc, t: acc + t["cnt"] * weight_of(t["grp"], weights))
    d = docs.withColumn("_total", total)
    keep = _keep_cols(docs)
    ex = exploded_counts(d.select(*keep, "counts", "_total"), keep + ["_total"])
    raw = F.col("cnt") * weight_of(F.col("grp"), weights)
    return (ex.withColumn("value", F.when(F.col("_total") > 0, raw / F.col("_total")).otherwise(F.lit(0.0)))
            .drop("_total"))


def binary_bow(docs: DataFrame, terms: str = "terms") -> DataFrame:
    """Value 1.0 for every term present in the document."""
    return term_counts(docs, terms).withColumn("value", F.lit(1.0)).drop("cnt")


# --------------------------------------------------------------------------
# corpus statistics (one aggregation each)
# --------------------------------------------------------------------------

def _train(docs: DataFrame, split: str | None) -> DataFrame:
    return docs.where(F.col("split") == split) if split else docs


def vocabulary(docs: DataFrame, split: str | None = "train", terms: str = "terms") -> DataFrame:
    """Distinct (word, grp) with document and term frequency."""
    tc = term_counts(_train(docs, split), terms)
    return tc.groupBy(*TERM).agg(F.count("*").alias("doc_freq"), F.sum("cnt").alias("term_freq"))


def idf(docs: DataFrame, split: str | None = "train", terms: str = "terms") -> DataFrame:
    """Smoothed IDF with the +1 of the reference's library:
    ``ln((1 + n) / (1 + df)) + 1``."""
    train = _train(docs, split)
    n = train.count()
    # ``array_distinct`` on structs compares all pairs of a document's terms; counted runs are distinct too
    known = train.withColumn("_known", F.filter(terms, lambda t: t.isNotNull()))
    dist = explode_rows(with_counts(known, "_known"), [], "counts").select(
        F.col("t.word").alias("word"), F.col("t.grp").alias("grp"))
    return (dist.groupBy(*TERM).agg(F.count("*").alias("df"))
            .withColumn("idf", F.log((F.lit(1.0 + n)) / (F.col("df") + 1.0)) + 1.0))


def tfidf(docs: DataFrame, idf_df: DataFrame, terms: str = "terms") -> DataFrame:
    """I3 + H20: ``cnt * idf`` for in-vocabulary terms, L2-normalised per
    document (a document without known terms has no rows)."""
    tc = term_counts(docs, terms)
    j = tc.join(idf_df.select(*TERM, "idf"), TERM, "inner").withColumn("_raw", F.col("cnt") * F.col("idf"))
    keep = _keep_cols(docs)
    # one shuffle by document; a document's distinct terms are its own few rows
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy("doc_id")))
    return j.withColumn("value", F.col("_raw") / norm).select(*keep, *TERM, "cnt", "idf", "value")


def in_vocabulary(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Keep only (word, grp) pairs known from training."""
    return pairs.join(vocab.select(*TERM).distinct(), TERM, "left_semi")


def class_sizes(docs: DataFrame, split: str | None = "train", label: str = "label") -> dict:
    """Documents per class (a bounded, tiny aggregate)."""
    rows = _train(docs, split).groupBy(label).agg(F.count("*").alias("n")).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"too many classes ({len(rows)})")
    return {r[label]: r["n"] for r in rows}


def class_sums(values: DataFrame, sizes: dict, value: str = "value", also: list | None = None) -> tuple[DataFrame, list]:
    """Per feature an exact sum for each class (``also``: further aggregates of the same pass)."""
    classes = sorted(sizes)
    v = F.col(value).cast(EXACT)
    aggs = [F.sum(F.when(F.col("label") == F.lit(c), v)).alias(f"_s{i}") for i, c in enumerate(classes)]
    return values.groupBy(*TERM).agg(*aggs, *(also or [])), classes


def centroids(values: DataFrame, sizes: dict, value: str = "value") -> DataFrame:
    """D9 + D10: corpus mean and class mean of every feature (zeros
    included, so a mean is a sum divided by the class size)."""
    sums, classes = class_sums(values, sizes, value)
    n = float(sum(sizes.values()))
    total = sum((F.coalesce(F.col(f"_s{i}"), F.lit(0)).cast("double") for i in range(len(classes))), F.lit(0.0))
    cols = [F.struct(F.lit(c).alias("label"),
                     (F.coalesce(F.col(f"_s{i}"), F.lit(0)).cast("double") / F.lit(float(sizes[c]))).alias("class_mean"))
            for i, c in enumerate(classes)]
    return (sums.select(*TERM, (total / F.lit(n)).alias("mean_all"), F.explode(F.array(*cols)).alias("c"))
            .select(*TERM, "c.label", "c.class_mean", "mean_all"))


def ocfs_from_sums(sums: DataFrame, classes: list, sizes: dict, keys: list = TERM) -> DataFrame:
    n = float(sum(sizes.values()))
    s = [F.coalesce(F.col(f"_s{i}"), F.lit(0)).cast("double") for i in range(len(classes))]
    mean_all = sum(s, F.lit(0.0)) / F.lit(n)
    score = F.lit(0.0)
    for i, c in enumerate(classes):
        nc = float(sizes[c])
        d = s[i] / F.lit(nc) - mean_all
        score = score + F.lit(1000.0) * F.lit(nc / n) * d * d
    return sums.select(*keys, score.alias("score"))


def ocfs_scores(values: DataFrame, sizes: dict, value: str = "value") -> DataFrame:
    """OCFS score of every feature,
    ``sum_c 1000 * (n_c / n) * (m_cj - m_j)^2`` over all classes (a class
    without the feature has m_cj = 0 and still counts).

    Class sums are exact decimals, so equal features get bit-equal scores
    whatever the summation order -- the cut-off's ties stay ties.
    """
    sums, classes = class_sums(values, sizes, value)
    return ocfs_from_sums(sums, classes, sizes)


def percentile_rank(n_delete: int, p: int) -> int:
    """The whole-percent rank the reference derives: k clipped to p, then
    Python's round (half to even) of k / p * 100."""
    if p == 0:
        raise ValueError("empty vocabulary: nothing to select")
    k = min(n_delete, p)
    return int(round((k / p) * 100))


def linear_percentile(df: DataFrame, col: str, q: float, p: int | None = None) -> float:
    """Exact linear-interpolation percentile (numpy's default) from two
    order statistics found by ``kth_smallest`` -- no global sort, no
    collect of the column."""
    if p is None:
        p = df.where(F.col(col).isNotNull()).count()
    h = q * (p - 1)
    lo_i, hi_i = math.floor(h), math.ceil(h)
    lo = kth_smallest(df, col, lo_i + 1)[None]
    hi = lo if hi_i == lo_i else kth_smallest(df, col, hi_i + 1)[None]
    if hi == lo:
        return lo
    return lo + (hi - lo) * (h - lo_i)


def ocfs_cut(scores: DataFrame, n_delete: int) -> float:
    """The score below which features are dropped."""
    p = scores.count()
    q = percentile_rank(n_delete, p)
    return linear_percentile(scores, "score", q / 100.0, p)


def ocfs_keep(scores: DataFrame, n_delete: int) -> DataFrame:
    """F4 (+B6): every feature with its score and whether it survives
    (``score >= cut``; ties at the cut are kept)."""
    cut = ocfs_cut(scores, n_delete)
    return scores.withColumn("cut", F.lit(cut)).withColumn("kept", F.col("score") >= F.lit(cut))


def ocfs_grid(docs: DataFrame, combos: list, sizes: dict, terms: str = "terms") -> DataFrame:
    """OCFS scores of many weightings in one job.

    Per document and weighting the L1 total is computed in-row; every
    (doc, term) pair then carries one value per weighting, and one grouped
    aggregation over (combo, term) with per-class sums gives all scores.
    The work is (pairs x weightings) by nature; grids beyond ``GRID_CHUNK``
    weightings are scored chunk by chunk, so a row's value array and the plan
    stay small whatever the grid.
    """
    if len(combos) > GRID_CHUNK:
        parts = [ocfs_grid(docs, combos[i:i + GRID_CHUNK], sizes, terms).withColumn("combo_id", F.col("combo_id") + i)
                 for i in range(0, len(combos), GRID_CHUNK)]
        return reduce(DataFrame.unionByName, parts)
    d = with_counts(_train(docs, "train"), terms)
    totals = F.array(*[F.aggregate("counts", F.lit(0.0), _weighted_sum(w))
                       for w in combos])
    d = d.withColumn("_tot", totals)
    ex = explode_rows(d, ["label", "_tot"], "counts")
    vals = F.array(*[F.when(F.col("_tot")[i] > 0, F.col("t.cnt") * weight_of(F.col("t.grp"), w) / F.col("_tot")[i])
                     .otherwise(F.lit(0.0)) for i, w in enumerate(combos)])
    long = ex.select("label", F.col("t.word").alias("word"), F.col("t.grp").alias("grp"),
                     F.posexplode(vals).alias("combo_id", "value"))
    classes = sorted(sizes)
    v = F.col("value").cast(EXACT)
    aggs = [F.sum(F.when(F.col("label") == F.lit(c), v)).alias(f"_s{i}") for i, c in enumerate(classes)]
    sums = long.groupBy("combo_id", *TERM).agg(*aggs)
    return ocfs_from_sums(sums, classes, sizes, ["combo_id"] + TERM)


def union_blocks(blocks: dict) -> DataFrame:
    """``{name: (df, weight)}`` -> one long frame ``doc_id, block, word,
    grp, value`` with each block's values scaled by its weight."""
    out = None
    for name, (df, w) in blocks.items():
        part = df.select("doc_id", F.lit(name).alias("block"), *TERM,
                         (F.col("value") * F.lit(float(w))).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
