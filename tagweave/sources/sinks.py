"""Writers (A6-A9) and the saved-runs reader (A10).  Model persistence
(A11) is Spark ML's own ``PipelineModel.write()/load`` (see models.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .raw import BOM, file_order


def write_labelled(df: DataFrame, path: str, index: str = "row_index", bom: bool = True) -> None:
    """Index, label, text; every field quoted, quotes doubled; with
    ``bom`` a byte-order mark in front of the row of index 0."""
    def quoted(c):
        return F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')),
                        F.lit('"'))
    line = F.concat_ws(",", quoted(index), quoted("label"), quoted("text"))
    if bom:
        line = F.when(F.col(index) == 0, F.concat(F.lit(BOM), line)).otherwise(line)
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def write_text_only(df: DataFrame, path: str, text: str = "text") -> None:
    """One text per line (the escape-char side effect is H12 in clean_text)."""
    df.select(F.regexp_replace(text, "[\r\n]", " ").alias("value")).write.mode("overwrite").text(path)


def write_cleaned(df: DataFrame, path: str) -> None:
    """The cleaned corpus as parquet."""
    df.write.mode("overwrite").parquet(path)


RUN_KEYS = ["dataset", "experiment", "metric"]


def save_runs(runs: DataFrame, path: str) -> None:
    """Search results by ``dataset``, ``experiment`` and ``metric``.

    The partitions that ``runs`` holds replace what was saved under the same
    keys, all others stay: saving a search twice leaves one copy."""
    runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN_KEYS).parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """A10: every saved run below ``path`` (partition columns restored);
    empty result sets are simply absent."""
    return spark.read.parquet(path)


def read_result_lists(spark: SparkSession, path: str) -> DataFrame:
    """A10 on text lists: every ``.txt`` file below ``path`` holds one run's
    best weightings, best first, one tuple a line: the weights, then train
    accuracy, test accuracy and macro F1.  Result: ``file, run_name, metric,
    weights, train_acc, test_acc, macro_f1`` of each file's first line; the
    metric is named by the file (``..._f1...`` or accuracy), lines that hold
    no numbers are left out."""
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path)
             .select("value", *file_order()).where(F.trim("value") != ""))
    first = (lines.groupBy(F.col("_file").alias("file"))
             .agg(F.min_by("value", F.struct("_start", "_row")).alias("line")))
    numbers = F.regexp_extract_all("line", F.lit(r"(?<![\w.])(\d+\.\d+(?:[eE]-?\d+)?|\d+)(?![\w.])"))
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.txt$", "")
    weights = F.regexp_extract("line", r"(\{[^}]*\})", 1)
    parsed = first.select("file", name.alias("run_name"),
                          F.when(F.lower(name).rlike("(^|[_-])(macro_?)?f1"), "f1").otherwise("accuracy").alias("metric"),
                          weights.alias("weights"), F.slice(numbers, -3, 3).alias("_n"))
    return (parsed.where(F.size("_n") == 3)
            .select("file", "run_name", "metric", "weights", F.col("_n")[0].cast("double").alias("train_acc"),
                    F.col("_n")[1].cast("double").alias("test_acc"), F.col("_n")[2].cast("double").alias("macro_f1")))
