"""Weight grids, search runs and leaderboards (H17, J5 results, B8, F2, D17, F3, B9).

A *run* is one weighting evaluated on the corpus: ``combo_id, weights,
train_acc, test_acc, macro_f1`` plus its configuration.  Runs are a
DataFrame; ranking them is plain ``orderBy``/``limit`` (the top-k is the
feature).
"""

from __future__ import annotations

import itertools
from functools import reduce
from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weight_grid(groups, scale: int, canonical: bool = True) -> list[dict]:
    """Every assignment of weights 1..scale to the groups, last group
    varying fastest.  With ``canonical`` the weightings that are multiples of
    another one are skipped: with an unweighted DEFAULT group the L1 rows are
    scale-free, so {A:2, V:2} scores exactly like {A:1, V:1}."""
    keys = list(groups)
    out = []
    for combo in itertools.product(range(1, scale + 1), repeat=len(keys)):
        if canonical and reduce(gcd, combo) != 1:
            continue
        out.append(dict(zip(keys, combo)))
    return out


def weights_label(w: dict) -> str:
    return ",".join(f"{k}:{v}" for k, v in w.items())


def beats_threshold(runs: DataFrame, accuracy_to_beat: float = 0.0, f1_to_beat: float = 0.0) -> DataFrame:
    """Keep runs whose test accuracy or macro F1 beats the bar."""
    return runs.where((F.col("test_acc") > accuracy_to_beat) | (F.col("macro_f1") > f1_to_beat))


METRICS = {"accuracy": "test_acc", "f1": "macro_f1"}


def spread_to_grid(runs: list[dict], groups, scale: int) -> list[dict]:
    """Scores of the canonical weightings mapped back to every point of
    the grid (a multiple scores like its canonical weighting), in grid order."""
    by_label = {r["weights"]: r for r in runs}
    out = []
    for i, w in enumerate(weight_grid(groups, scale, canonical=False)):
        d = reduce(gcd, w.values())
        found = by_label.get(weights_label({k: v // d for k, v in w.items()}))
        if found is not None:
            out.append({**found, "combo_id": i, "weights": weights_label(w)})
    return out


def top_runs(runs: DataFrame, k: int = 20, key: str = "run_name") -> DataFrame:
    """the two saved result lists of every search, the best ``k`` runs by
    accuracy and by F1, ties in combo order, with ``metric`` and 1-based
    ``rank``.  Both lists come from one pass over the runs."""
    each = runs.withColumn("metric", F.explode(F.array(*[F.lit(m) for m in METRICS])))
    value = F.when(F.col("metric") == "accuracy", F.col("test_acc")).otherwise(F.col("macro_f1"))
    w = Window.partitionBy(key, "metric").orderBy(F.desc("_value"), "combo_id")
    return (each.withColumn("_value", value).withColumn("rank", F.row_number().over(w).cast("long"))
            .where(F.col("rank") <= k).drop("_value"))


def best_per_run(results: DataFrame, key: str = "run_name") -> DataFrame:
    """The first (best) line of every saved result list."""
    sort_metric = F.when(F.col("metric") == "accuracy", F.col("test_acc")).otherwise(F.col("macro_f1"))
    best = F.max_by(F.struct(*[c for c in results.columns if c not in (key, "metric")]),
                    F.struct(sort_metric, -F.col("combo_id")))
    return results.groupBy(key, "metric").agg(best.alias("b")).select(key, "metric", "b.*")


def leaderboard(best: DataFrame, metric: str, k: int = 10) -> DataFrame:
    """F3 + B9: the ``k`` best saved runs for one metric kind."""
    col = "test_acc" if metric == "accuracy" else "macro_f1"
    return best.where(F.col("metric") == metric).orderBy(F.desc(col), "run_name").limit(k)
