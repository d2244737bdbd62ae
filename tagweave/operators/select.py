"""Exact order statistics without a global sort or a single-task window.

``kth_smallest`` finds the k-th smallest value of a numeric column (per
group, for a bounded number of groups) by histogram refinement: each pass
is one scan with a partial aggregation into at most ``buckets`` rows per
group; the bucket holding rank k becomes the next range.  What reaches the
driver per pass is bounded by ``groups x buckets`` rows, whatever the data
size, and the last pass collects at most ``max_collect`` values in all.

``global_index`` is the DataFrame form of ``zipWithIndex``: range-partition,
sort inside partitions, checkpoint (so the partitioning is fixed), count per
partition, add the partition's offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage


def _map_lit(d: dict) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def kth_smallest(df: DataFrame, value: str, k, group: str | None = None,
                 buckets: int = 1024, max_collect: int = 50_000) -> dict:
    """Exact k-th smallest (1-based) of ``value`` per ``group``.

    ``k`` is an int (same rank for every group) or a dict group -> rank.
    Returns dict group -> value (key ``None`` when ungrouped); groups whose
    rank exceeds their size are omitted.  The open groups' ranges travel as
    a small joined frame (one row per group), and values are collected only
    when those of all open groups together are at most ``max_collect``.
    """
    spark = df.sparkSession
    g = F.col(group).cast("string") if group else F.lit(None).cast("string")
    base = df.select(g.alias("_g"), F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    kind = base.schema["_v"].dataType
    # whole numbers are bucketed in exact arithmetic: doubles would merge
    # neighbours beyond 2^53 and the range would never shrink
    exact = isinstance(kind, T.IntegralType)
    state, result = {}, {}
    for r in base.groupBy("_g").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect():
        kk = k.get(r["_g"]) if isinstance(k, dict) else k
        if kk is not None and 1 <= kk <= r["n"]:
            state[r["_g"]] = (r["lo"], r["hi"], kk, r["n"])
    schema = T.StructType([T.StructField("_sg", T.StringType()), T.StructField("_lo", kind), T.StructField("_hi", kind)])
    while True:
        for gk in [gk for gk, st in state.items() if st[0] == st[1]]:
            result[gk] = state.pop(gk)[0]
        if not state:
            return result
        ranges = spark.createDataFrame([(gk, st[0], st[1]) for gk, st in state.items()], schema)
        left = base.join(ranges, F.col("_g").eqNullSafe(F.col("_sg")) & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        if sum(st[3] for st in state.values()) <= max_collect:
            values = {}
            for r in left.select("_g", "_v").collect():
                values.setdefault(r["_g"], []).append(r["_v"])
            result.update({gk: sorted(values[gk])[st[2] - 1] for gk, st in state.items()})
            return result
        if exact:
            v, lo, hi = (F.col(c).cast("decimal(28,0)") for c in ("_v", "_lo", "_hi"))
            bucket = F.floor((v - lo) * buckets / (hi - lo + 1)).cast("long")
        else:
            v, lo, hi = (F.col(c).cast("double") for c in ("_v", "_lo", "_hi"))
            bucket = F.least(F.lit(buckets - 1), F.floor((v - lo) / (hi - lo) * buckets).cast("long"))
        hist = left.groupBy("_g", bucket.alias("_b")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"),
                                                           F.max("_v").alias("hi")).collect()
        before = dict.fromkeys(state, 0)
        found = {}
        for r in sorted(hist, key=lambda r: r["_b"]):
            gk = r["_g"]
            if gk not in found and before[gk] + r["n"] >= state[gk][2]:
                found[gk] = (r["lo"], r["hi"], state[gk][2] - before[gk], r["n"])
            before[gk] += r["n"]
        state = found


def kth_smallest_many(df: DataFrame, value: str, ranks: list, max_collect: int = 50_000) -> tuple[int, list]:
    """Several exact order statistics of one column (1-based ranks) and the
    non-null count.  Small inputs cost one stats scan and one collect of the
    single column; larger ones fall back to ``kth_smallest`` per rank."""
    base = df.select(F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    n = base.count()
    want = [r for r in ranks if 1 <= r <= n]
    if not want:
        return n, [None] * len(ranks)
    if n <= max_collect:
        vals = sorted(r[0] for r in base.collect())
        got = {r: vals[r - 1] for r in want}
    else:
        got = {r: kth_smallest(df, value, r)[None] for r in want}
    return n, [got.get(r) for r in ranks]


def global_index(df: DataFrame, order_cols: list, index_col: str = "idx",
                 num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based position in ``order_cols`` order (ties broken by the
    listed columns only, so pass a unique key last)."""
    spark = df.sparkSession
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_df = (df.repartitionByRange(n_parts, *order_cols).sortWithinPartitions(*order_cols)
                 .withColumn("_pid", F.spark_partition_id())
                 .withColumn("_mid", F.monotonically_increasing_id()))
    fixed = cut_lineage(sorted_df)
    counts = {r["_pid"]: r["n"] for r in fixed.groupBy("_pid").agg(F.count("*").alias("n")).collect()}
    offsets, acc = {}, 0
    for pid in sorted(counts):
        offsets[pid] = acc
        acc += counts[pid]
    off = _map_lit({int(p): int(o) for p, o in offsets.items()}) if offsets else F.create_map().cast("map<int,bigint>")
    pos_in_part = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (fixed.withColumn(index_col, F.try_element_at(off, F.col("_pid")) + pos_in_part)
            .drop("_pid", "_mid"))
