"""Row selection, de-duplication, balancing, shuffling and splitting.

B1 drop_broken, E1 dedupe_first, E3 balance_classes, F1 shuffle_key /
shuffled, E4 with_index, E2 split_by_position, B3 row_range.

None of these runs a window over a whole class or the whole table: cut
points come from ``kth_smallest`` (bounded driver traffic), so a class
holding a third of all rows never lands in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .select import global_index, kth_smallest, kth_smallest_many


def drop_broken(df: DataFrame, text: str = "text") -> DataFrame:
    """B1: drop rows whose text is NULL or holds a tab (a broken record)."""
    return df.where(F.col(text).isNotNull() & ~F.col(text).contains("\t"))


def dedupe_first(df: DataFrame, key, order: str = "doc_id") -> DataFrame:
    """Keep the first row (smallest ``order``) of every ``key``.

    A null key marks no copy: such rows are all kept.  Two steps, both skew-proof: a partial-aggregated ``min(order)`` per key
    (a hot key collapses map-side to one row per task), then a left-semi join
    on the unique ``order`` column.
    """
    k = F.col(key) if isinstance(key, str) else key
    lone = F.when(k.isNull(), F.col(order))
    firsts = df.groupBy(k.alias("_k"), lone.alias("_lone")).agg(F.min(order).alias(order)).select(order)
    return df.join(firsts, order, "left_semi")


def shuffle_key(id_col: str = "doc_id", seed: int = 42) -> Column:
    """a seeded, reproducible pseudo-random order key (60 bits of md5)."""
    h = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(id_col).cast("string")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def sql_shuffle_hex(id_col: str = "doc_id", seed: int = 42) -> str:
    """Oracle form: the same 15 hex digits (same order as the number)."""
    return f"substr(md5('{seed}:' || CAST({id_col} AS VARCHAR)), 1, 15)"


def shuffled(df: DataFrame, id_col: str = "doc_id", seed: int = 42,
             index_col: str = "row_index") -> DataFrame:
    """F1 + E4: seeded shuffle with a fresh 0-based row index."""
    keyed = df.withColumn("_sk", shuffle_key(id_col, seed))
    return global_index(keyed, ["_sk", id_col], index_col).drop("_sk")


def with_index(df: DataFrame, order: list, index_col: str = "row_index") -> DataFrame:
    """0-based index in a given order (order must end with a unique key)."""
    return global_index(df, order, index_col)


def _cut_below(df: DataFrame, order: str, rank: int, n: int):
    """Value of ``order`` at 0-based position ``rank`` (None when rank >= n)."""
    if rank >= n:
        return None
    return kth_smallest(df, order, rank + 1)[None]


def split_points(n: int, train: float = 0.7, test: float = 0.2) -> tuple[int, int]:
    """Positional cuts computed in double like the reference: floor(t*n),
    floor((1 - u)*n)."""
    return math.floor(train * n), math.floor((1.0 - test) * n)


def split_by_position(df: DataFrame, order: str = "doc_id", train: float = 0.7,
                      test: float = 0.2, split_col: str = "split") -> DataFrame:
    """First ``train`` share -> 'train', last ``test`` share -> 'test',
    the middle -> 'dev'; by position in ``order`` (a unique column).

    Two cut values are found with ``kth_smallest`` and applied as plain
    filters: no global window, no sort of the data.
    """
    # one pass over whatever made the rows; the rest reads this one column
    keys = cut_lineage(df.select(order))
    n = keys.count()
    train_end, test_start = split_points(n, train, test)
    # value at 0-based position p is the (p + 1)-th smallest
    _, (c1, c2) = kth_smallest_many(keys, order, [train_end + 1, test_start + 1])
    o = F.col(order)
    is_train = F.lit(True) if c1 is None else o < F.lit(c1)
    is_dev = F.lit(True) if c2 is None else o < F.lit(c2)
    return df.withColumn(split_col, F.when(is_train, "train").when(is_dev, "dev").otherwise("test"))


def row_range(df: DataFrame, order: str, start=None, end=None) -> DataFrame:
    """Rows at positions [start, end) in ``order`` order; a falsy end
    means all rows, start is clamped to end (the reference's rules)."""
    keys = cut_lineage(df.select(order))
    n = keys.count()
    start = start or 0
    end = end or n
    end = min(end, n)
    if start > end:
        start = end
    lo = _cut_below(keys, order, start, n)
    hi = _cut_below(keys, order, end, n)
    o = F.col(order)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (o >= F.lit(lo))
    else:
        cond = F.lit(False)
    if hi is not None:
        cond = cond & (o < F.lit(hi))
    return df.where(cond)


def balance_classes(df: DataFrame, label: str = "label", id_col: str = "doc_id",
                    seed: int = 42) -> DataFrame:
    """E3 (+D3): per class keep the ``min class size`` rows that come first in
    a seeded shuffle of that class.

    The per-class cut on the shuffle key is found by ``kth_smallest``; rows
    are then kept by a filter, so no class is ever gathered into one task.
    """
    keyed = df.withColumn("_sk", shuffle_key(id_col, seed))
    sizes = {r[label]: r["n"] for r in keyed.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return df
    m = min(sizes.values())
    cuts = kth_smallest(keyed, "_sk", m, group=label)
    items = []
    for k, v in cuts.items():
        items += [F.lit(k), F.lit(v)]
    cut = F.try_element_at(F.create_map(*items), F.col(label))
    below = keyed.where(F.col("_sk") < cut)
    # rows sharing the cut key (normally exactly one per class): rank them
    # by id inside that tiny set to honour ties exactly
    at_cut = keyed.where(F.col("_sk") == cut)
    taken = {r[label]: r["n"] for r in below.groupBy(label).agg(F.count("*").alias("n")).collect()}
    need = {k: m - taken.get(k, 0) for k in sizes}
    items = []
    for k, v in need.items():
        items += [F.lit(k), F.lit(v)]
    from pyspark.sql import Window
    w = Window.partitionBy(label).orderBy(id_col)
    at_cut = (at_cut.withColumn("_r", F.row_number().over(w))
              .where(F.col("_r") <= F.try_element_at(F.create_map(*items), F.col(label))).drop("_r"))
    return below.unionByName(at_cut).drop("_sk")
