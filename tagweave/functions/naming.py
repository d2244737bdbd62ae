"""Names of search runs and persisted models.

Both a Column form (for runs tables) and a plain-Python form (for the
driver-side search loop) are given; tests check they agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def groups_from_weights(weights: dict) -> dict:
    """``{"A+E": 4}`` -> ``{"A+E": ["A", "E"]}``."""
    return {k: k.split("+") for k in weights}


def groups_from_weights_col(weights: Column) -> Column:
    """H16 on a MAP<STRING, INT> column."""
    return F.transform_values(weights, lambda k, v: F.split(k, r"\+"))


def _fmt(v) -> str:
    return str(v)


def run_name(groups: dict, scale: int, n_delete: int, block_weights: dict,
             train: float, test: float) -> str:
    """H18, e.g. ``A-E_scale_1_del_0_bow_0.7_pos_0.3_train_0.7_test_0.2``."""
    parts = ["-".join(v) if v else "DEFAULT" for v in sorted(groups.values())]
    blocks = "".join(f"_{k}_{_fmt(block_weights[k])}" for k in sorted(block_weights))
    return (f"{'_'.join(parts)}_scale_{scale}_del_{n_delete}{blocks}"
            f"_train_{_fmt(train)}_test_{_fmt(test)}")


def model_name(weights: dict, n_delete: int, block_weights: dict, train: float) -> str:
    """H19, e.g. ``!4_A4_E2_R1_35000_bow_0.5_pos_0.5_0.7``."""
    head = "".join(f"{k}{weights[k]}_" for k in sorted(weights))
    blocks = "".join(f"_{k}_{_fmt(block_weights[k])}" for k in sorted(block_weights))
    return f"{head}{n_delete}{blocks}_{_fmt(train)}"


def _blocks_col(block_weights: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(block_weights)),
                                    lambda e: F.concat(F.lit("_"), e["key"], F.lit("_"),
                                                       e["value"].cast("string"))), "")


def run_name_col(groups: Column, scale: Column, n_delete: Column, block_weights: Column,
                 train: Column, test: Column) -> Column:
    """H18 over config columns: groups MAP<STRING, ARRAY<STRING>>,
    block_weights MAP<STRING, DOUBLE>."""
    parts = F.transform(F.array_sort(F.map_values(groups)),
                        lambda v: F.when(F.size(v) == 0, F.lit("DEFAULT")).otherwise(F.array_join(v, "-")))
    return F.concat(F.array_join(parts, "_"), F.lit("_scale_"), scale.cast("string"),
                    F.lit("_del_"), n_delete.cast("string"), _blocks_col(block_weights),
                    F.lit("_train_"), train.cast("string"), F.lit("_test_"), test.cast("string"))


def model_name_col(weights: Column, n_delete: Column, block_weights: Column, train: Column) -> Column:
    """H19 over config columns: weights MAP<STRING, INT>."""
    head = F.array_join(F.transform(F.array_sort(F.map_entries(weights)),
                                    lambda e: F.concat(e["key"], e["value"].cast("string"), F.lit("_"))), "")
    return F.concat(head, n_delete.cast("string"), _blocks_col(block_weights), F.lit("_"),
                    train.cast("string"))
