"""Readers for the reference's raw and processed files (A1-A3, A5).

Multi-path reads replace the byte-level file merge (A2/G1): one
``spark.read`` over a glob or list is the union, and ``_metadata`` keeps
each row's file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW_SCHEMA = "id string, sentiment string, text string, to_delete string"
LABELLED_SCHEMA = "doc_pos long, label string, text string"
BOM = "﻿"


def file_order() -> list:
    """Position of a row over many files: path, then the split's offset in the
    file, then the order within the split (a split is read by one task)."""
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_row")]



def read_raw(spark: SparkSession, paths, quote_mode: str = "line") -> DataFrame:
    """A1/A2: header-less tab-separated tweets, 3 or 4 fields.

    ``line`` (default): one record per line, quotes are plain characters --
    splittable, nothing swallowed.  ``quoted``: the reference's quoting (an
    unclosed leading quote swallows following lines; the record then holds
    a tab and is dropped by B1) -- not splittable, for reproduction only.
    """
    r = spark.read.schema(RAW_SCHEMA).option("sep", "\t").option("header", False).option("encoding", "UTF-8")
    if quote_mode == "line":
        r = r.option("quote", "")
    elif quote_mode == "quoted":
        r = r.option("quote", '"').option("escape", '"').option("multiLine", True)
    else:
        raise ValueError(f"unknown quote_mode {quote_mode!r}")
    df = r.csv(paths if isinstance(paths, (list, tuple)) else [paths])
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def quoted_records(spark: SparkSession, paths) -> DataFrame:
    """``_file, record``: the whole records of quoted files, line ends inside quotes included.

    Every file is read by as many tasks as it has splits.  A line's quotes say whether it turns
    the quoting on or off; each split's sum is composed over the splits before it (one row per
    split), so a line knows whether it starts inside quotes.  Lines that are records of their own
    are done; only the lines of longer records, which may cross splits, meet by record.  Files
    must be well formed: quotes stand around fields, and doubled inside them.  A record left open
    at the end of a file runs to its end.  Blank lines between records are no records.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(F.col("value").alias("line"), *file_order()) \
        .withColumn("odd", F.length(F.regexp_replace("line", '[^"]', "")) % 2)
    split = Window.partitionBy("_file", "_start")
    before = F.sum("odd").over(split.orderBy("_row").rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("before", F.coalesce(before, F.lit(0)))
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    turns = lines.groupBy("_file", "_start").agg(F.sum("odd").alias("odd")) \
        .select("_file", "_start", F.coalesce(F.sum("odd").over(earlier), F.lit(0)).alias("carried"))
    lines = lines.join(turns, ["_file", "_start"]).withColumn("inside", (F.col("carried") + F.col("before")) % 2)
    whole = lines.filter("inside = 0 and odd = 0").select("_file", F.col("line").alias("record"))
    # Of the lines of longer records, the first turns quoting on and the last turns it off: the turns
    # up to and with the first line, halved, number the record.
    number = F.floor((F.col("carried") + F.col("before") + F.when(F.col("inside") == 0, 1).otherwise(0)) / 2 + F.lit(0.5))
    parts = lines.filter("inside = 1 or odd = 1").groupBy("_file", number.alias("number")) \
        .agg(F.array_sort(F.collect_list(F.struct("_start", "_row", "line"))).alias("lines"))
    joined = parts.select("_file", F.array_join("lines.line", "\n").alias("record"))
    return whole.unionByName(joined).select("_file", F.regexp_replace("record", "\r$", "").alias("record")).filter("record <> ''")


def read_labelled(spark: SparkSession, path: str, splittable: bool = True) -> DataFrame:
    """A3: the processed labelled table (index, label, text; all quoted, BOM).

    Fields may hold line ends.  ``splittable`` (default): many tasks read one file
    (``quoted_records``).  Otherwise a file is one record stream of one task, which also
    takes files with quotes elsewhere than around fields.
    """
    schema, quoting = "_pos string, label string, text string", {"quote": '"', "escape": '"'}
    if splittable:
        # a BOM in front of the first field of a file would hide its quotes
        record = F.regexp_replace("record", "^" + BOM, "")
        df = quoted_records(spark, path).select(F.from_csv(record, schema, quoting).alias("r")).select("r.*")
    else:
        df = spark.read.schema(schema).options(**quoting, multiLine=True, header=False).csv(path)
    pos = F.regexp_replace("_pos", f'[{BOM}"]', "").cast("long")
    return df.select(pos.alias("doc_pos"), "label", "text")


def read_labels(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """A3 + B3: ``doc_pos, label`` for rows [start, end)."""
    from ..operators.sampling import row_range
    df = read_labelled(spark, path).select("doc_pos", "label")
    return row_range(df, "doc_pos", start, end) if (start or end) else df


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """A5: one document per line, BOM stripped, with its line position."""
    from ..operators.select import global_index
    df = spark.read.text(path).select(F.ltrim(F.regexp_replace("value", "^" + BOM, "")).alias("text"), *file_order())
    return global_index(df, ["_file", "_start", "_row"], "doc_pos").select("text", "doc_pos")
