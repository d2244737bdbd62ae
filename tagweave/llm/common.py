"""Helpers shared by the operators of this subpackage.

Conventions that every operator of the subpackage keeps:

* it selects the columns it needs by name and returns exactly the columns its docstring
  states, so extra input columns, whatever their names, never reach its internals;
* a null text counts as the empty text unless its docstring says otherwise;
* ids are carried through untouched: null and repeated ids are kept, row for row, unless the
  operator is defined on ids.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Entries a word cache holds before it starts anew (bounds memory, not results).
CACHE_ENTRIES = 250_000

#: Rows and bytes of a batch that travels between Spark and Python.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

_held: dict = {}


def held(key, make: Callable[[], object]):
    """The helper of this worker process, made when first asked for and shared by its tasks.

    Only the latest is kept: a worker that goes on to another operator's tasks gives the caches
    of the one before back.
    """
    if key not in _held:
        _held.clear()
        gc.collect()
        _held[key] = make()
    return _held[key]

#: Key of ``map_texts`` results: the input place of each output row.
ROW = "__row"


def schema_of(df: DataFrame, keep: list[str], more: str) -> T.StructType:
    """Schema with the columns ``keep`` of ``df`` as they are, then the DDL columns ``more``."""
    fields = [T.StructField(c, df.schema[c].dataType, True) for c in keep]
    return T.StructType(fields + T._parse_datatype_string(more).fields)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes.

    Texts may be long, and a task holds a batch several times over (rows, Arrow buffers on both
    sides, Python objects).  The limits are the session's settings, which are only ever lowered.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # the default
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc: freed memory goes back
            if trim:
                trim(0)

    return df.mapInArrow(run, schema)


def map_texts(df: DataFrame, keep: list[str], text: str, more: str,
              rows: Callable[[], Callable[[list[str | None]], dict[str, list]]]) -> DataFrame:
    """``keep`` columns plus what is computed from ``text``, one output row per input row.

    ``rows()`` runs once per task and returns a function from a list of texts to a dict of
    equally long output columns (names as in the DDL ``more``).  With a further entry
    ``ROW`` (input place of each output row) a text may give any number of rows.
    """
    names = [f.name for f in T._parse_datatype_string(more).fields]
    out = schema_of(df, keep, more)
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # word caches hold many small objects and no cycles
        try:
            compute = rows()
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    got = compute(part.column(part.num_columns - 1).to_pylist())
                    kept = part.take(pa.array(got[ROW], pa.int64())) if ROW in got else part
                    cols = [kept.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
                    cols += [pa.array(got[n], type=arrow.field(len(keep) + i).type) for i, n in enumerate(names)]
                    yield pa.RecordBatch.from_arrays(cols, schema=arrow)
        finally:
            gc.enable()

    return map_arrow(df.select(*keep, df[text].alias("__text")), run, out)
