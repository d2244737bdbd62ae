"""Tagged corpus in CoNLL blocks (``word TAB tag [TAB confidence]``
per line, blank line between documents) -> ``doc_pos, tokens``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.select import global_index
from .raw import file_order


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """Each blank-line separated block is one document; its position over
    the files in path order is ``doc_pos`` (0-based).  Blocks without tokens are skipped, as a
    block reader skips repeated blank lines."""
    raw = (spark.read.option("lineSep", "\n\n").text(path)
           .select(*file_order(), F.col("value")))
    lines = F.filter(F.split(F.col("value"), "\n"), lambda l: F.length(F.trim(l)) > 0)
    tokens = F.transform(lines, lambda l: F.struct(F.split(l, "\t")[0].alias("word"),
                                                   F.split(l, "\t")[1].alias("tag")))
    docs = raw.select("_file", "_start", "_row", tokens.alias("tokens")).where(F.size("tokens") > 0)
    return global_index(docs, ["_file", "_start", "_row"], "doc_pos").select("doc_pos", "tokens")


def join_labels(tokens: DataFrame, labels: DataFrame, strict: bool = True) -> DataFrame:
    """C1 for position-keyed inputs: tagged blocks and labels must have equal
    counts (a shifted file would misalign every later label)."""
    if strict:
        nt, nl = tokens.count(), labels.count()
        if nt != nl:
            raise ValueError(f"{nt} tagged documents but {nl} labels: positions would not align")
    return tokens.join(labels, "doc_pos", "inner")
