"""A whole grid of weightings scored together (C6, H17, J5 scorer, B8, F2, D17, F3 at any scale).

A weighting only changes how a term's counts are scaled: the value of term t of group g in a
document with group counts c is cnt * w_g / sum(w * c).  So the corpus travels once, as narrow
rows (term, document, count, group counts), dealt by term and packed into one row per term.  A
task works on arrays with one place per weighting, ``STEP`` rows at a time however many a term
has: class sums, OCFS scores, whether the term survives, class means, and what the term adds to
its documents' distances.  No row is ever written per weighting and term; arrays leave a task
only summed by document over all its terms, by histogram bucket or as a short list.

Documents are counted a batch at a time and leave a task with one row per term of the batch; the
rows of a term meet once.  The packed rows are written once and read by every pass; ``LANES`` weightings
share a pass.  One pass finds all that does not depend on a cut.  The passes that add up distances read the
rows in as many tasks as run at a time, whatever the input: a task hands on one sum per document, so its
output grows with the documents, not with tasks times documents.  ``DOT_SENT`` bounds that output and
``DOT_BYTES`` what a task holds, and with them the weightings of such a pass, whose shuffled files go when
it ends; only where the sums of one weighting are too many do tasks hold one range of documents at a time.

Class sums are exact: values count in units of 1e-12 as whole numbers, so equal features keep
equal scores whatever the order of summation, and cuts are reproducible.  (Exact up to a mass
of 9e6 of one term and class within a task's rows, and per term.)
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_folder
from . import longform as L
from .evaluate import REPORT_LABELS, _prf

#: Weightings of one pass (8 bytes a class and weighting in a task's row of a document).
LANES = 640
#: Rows of a term from which on its rows are spread over several tasks (56 bytes each with four groups).
HOT_ROWS = 250_000
#: Rows whose arrays a task works on at a time, at most, and numbers (rows x weightings) of such an array.
STEP = 16_384
STEP_CELLS = 131_072
#: Such steps whose distances are added up by document before they go to the others'.
DOT_STEPS = 4
#: Terms of documents that are counted at a time.
COUNTED = 1_000_000
#: Weightings whose distances are added up in one pass, at most.
DOT_LANES = 96
#: Tasks over the term rows that add up distances of a range of documents, at most.
DOT_TASKS = 32
#: Bytes of a document's sums (one per class and weighting) that all tasks of a pass hand on.
DOT_SENT = 12_288
#: Bytes of distances that a task adds up before it hands them on; those of a pass's documents have half of it.
DOT_BYTES = 160 << 20
#: Buckets of one pass of the search for the cut.
BUCKETS = 1024
UNIT = 1e12
#: The bit pattern of infinity.
INFINITE = int(np.array(np.inf).view(np.int64))


class Setting(NamedTuple):
    """What every task knows: weights (groups x lanes), class sizes and the classes in order."""

    weights: np.ndarray
    sizes: np.ndarray
    labels: list


class Profile(NamedTuple):
    """What does not depend on a cut: the terms, per lane the filled buckets of their scores, and classes x lanes, the
    squared length of the class means over all terms."""

    n_terms: int
    buckets: list
    norms: np.ndarray


class Terms(NamedTuple):
    """Some terms of a task, with their class sums over all training rows (units, terms x classes x lanes)."""

    word: list
    grp: list
    part: list
    sums: np.ndarray
    rows: np.ndarray        # document, 2 * class + training, count and group counts, by row of a term
    starts: np.ndarray      # where each term's rows start, and their end
    seen: np.ndarray        # whether the vocabulary (training rows) has it
    once: np.ndarray        # false for all but one of the parts of a term dealt in parts


@contextmanager
def _shuffles_dropped(spark):
    """Shuffled files of the actions run here are removed as each ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def term_rows(docs: DataFrame, groups: list[str], labels: list, terms: str = "terms") -> DataFrame:
    """``word, grp, part, n_train, rows`` of all terms, written once: ``rows`` holds the term's (document, class,
    count, group counts) as whole numbers; a term beyond ``HOT_ROWS`` rows is dealt in parts."""
    y = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")).cast("long") - 1
    code = 2 * F.coalesce(y, F.lit(-1)) + F.coalesce(F.col("split") == "train", F.lit(False)).cast("long")
    groups = list(groups)
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), code.cast("int").alias("code"), F.col(terms).alias("terms")).mapInArrow(
        lambda batches: _pieces(batches, groups), "word string, grp string, n int, first long, rows binary")
    # a document has one row of a term
    if docs.count() > HOT_ROWS:
        hot = cut_lineage(pieces.groupBy("word", "grp").agg(F.sum("n").alias("n")).where(F.col("n") > HOT_ROWS)
                          .select("word", "grp", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("parts")))
        pieces = pieces.join(hot, ["word", "grp"], "left").withColumn(
            "part", F.coalesce(F.pmod(F.xxhash64("first"), F.col("parts")).cast("int"), F.lit(-1))).drop("parts")
    else:
        pieces = pieces.withColumn("part", F.lit(-1))
    by = ["word", "grp", "part"]

    def pack(batches):
        """All (term, part) that end in a batch become one batch; the last one stays open."""
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, ends = _bytes_of(batch["rows"])
            rows = flat.view(np.int32).reshape(-1, 4 + len(groups))
            starts = _starts(batch, by)
            at = ends[[*starts, batch.num_rows]] // (4 * rows.shape[1])
            names = [batch[c].take(pa.array(starts)) for c in by]
            if held and tuple(x[0].as_py() for x in names) != key:
                yield _packed([[x] for x in key], np.concatenate(held), [0])
                held = []
            if len(starts) > 1:
                upto = int(at[-2])
                yield _packed([x[:-1] for x in names], np.concatenate([*held, rows[:upto]]),
                              [0, *(at[1:-2] + sum(len(x) for x in held))])
                held = []
            key = tuple(x[-1].as_py() for x in names)
            held.append(rows[at[-2]:].copy())
        if held:
            yield _packed([[x] for x in key], np.concatenate(held), [0])

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = pieces.select(*by, "rows").repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(
        pack, "word string, grp string, part int, n_train long, rows binary")
    path = shared_folder(spark, "term-rows")
    with _shuffles_dropped(spark):
        packed.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(packed.schema).parquet(path)


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and where each value begins, and the end."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, ends, data = array.buffers()
    wide = pa.types.is_large_binary(array.type)
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0]:at[-1]], at - at[0]


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of ``data``'s bytes cut at ``ends`` (0 first)."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _pieces(batches: Iterator[pa.RecordBatch], groups: list[str]) -> Iterator[pa.RecordBatch]:
    """``word, grp, n, first, rows`` of documents (``doc_id, code, terms``): some documents at a time, for each of their terms
    the number of its documents, the first of them and their packed rows (32-bit; the document takes two)."""
    for whole in batches:
        terms = whole["terms"]
        lengths = pc.fill_null(pc.list_value_length(terms), 0).to_numpy().astype(np.int64)
        before = np.cumsum(lengths) - lengths
        cuts = np.flatnonzero(np.diff(before // COUNTED, prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(lengths)]):
            if lengths[lo:hi].any():
                yield _counted(whole["doc_id"].to_numpy()[lo:hi], whole["code"].to_numpy()[lo:hi], lengths[lo:hi],
                               terms.slice(lo, hi - lo).flatten(), groups)


def _counted(doc: np.ndarray, code: np.ndarray, lengths: np.ndarray, flat: pa.StructArray, groups: list[str]) -> pa.RecordBatch:
    def numbered(column):
        """The values and the number of each entry; a null is one more value."""
        coded = column.dictionary_encode()
        values = pa.concat_arrays([coded.dictionary, pa.nulls(1, column.type)])
        return values, pc.fill_null(coded.indices, len(values) - 1).to_numpy().astype(np.int64)

    (words, w), (grps, g) = (numbered(pc.struct_field(flat, f)) for f in ("word", "grp"))
    row = np.repeat(np.arange(len(doc)), lengths)
    names = {x: i for i, x in enumerate(grps.to_pylist())}
    own = [np.bincount(row[g == names[x]], minlength=len(doc)) if x in names else np.zeros(len(doc), np.int64) for x in groups]
    key, cnt = np.unique((w * len(grps) + g) * len(doc) + row, return_counts=True)
    term, row = np.divmod(key, len(doc))
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    rows = np.empty((len(key), 4 + len(groups)), np.int32)
    rows[:, :2] = np.ascontiguousarray(doc[row], np.int64).view(np.int32).reshape(-1, 2)
    for i, x in enumerate((code[row], cnt, *(x[row] for x in own)), 2):
        rows[:, i] = x
    ends = np.append(starts, len(key))
    return pa.RecordBatch.from_pydict({
        "word": words.take(pa.array(term[starts] // len(grps))), "grp": grps.take(pa.array(term[starts] % len(grps))),
        "n": pa.array(np.diff(ends), pa.int32()), "first": pa.array(doc[row[starts]].astype(np.int64)),
        "rows": _binary(rows, ends * (4 * rows.shape[1]))})


def _values(rows: np.ndarray, own: np.ndarray, s: Setting) -> np.ndarray:
    """rows x lanes: POS-weighted L1 values; ``own`` holds the weights of each row's group."""
    totals = rows[3:].T.astype(float) @ s.weights
    raw = rows[2][:, None] * own
    none = ~(totals > 0)
    if none.any():
        totals[none], raw[none] = 1.0, 0.0
    raw /= totals
    return raw


def _units(values: np.ndarray) -> np.ndarray:
    """Values as whole numbers of units; ``values`` is used up."""
    values *= UNIT
    values += 0.5
    return np.floor(values, out=values).astype(np.int64)


def _step(s: Setting) -> int:
    """Rows that are worked on at a time."""
    return max(1, min(STEP, max(64, STEP_CELLS // max(1, s.weights.shape[1]))))


def _starts(batch: pa.RecordBatch, by: list[str]) -> list[int]:
    """Where rows begin that differ in ``by`` from the one before; 0 is the first."""
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    for c in by:
        new[1:] |= pc.not_equal(batch[c][1:], batch[c][:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new).tolist()


def _packed(names: list, rows: np.ndarray, starts: list[int]) -> pa.RecordBatch:
    """One row per (word, grp, part): its rows (32-bit, one after the other) column after column, as 64-bit numbers."""
    starts = np.asarray(starts, np.int64)
    n = np.diff(np.append(starts, len(rows)))
    columns = [np.ascontiguousarray(rows[:, :2]).view(np.int64)[:, 0], *rows.T[2:]]
    flat = np.empty(len(rows) * len(columns), np.int64)
    start, own = np.repeat(starts, n), np.repeat(n, n)
    place = start * (len(columns) - 1) + np.arange(len(rows))
    for column in columns:
        flat[place] = column
        place += own
    word, grp, part = (x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(names, (pa.string(), pa.string(), pa.int32())))
    return pa.RecordBatch.from_pydict({
        "word": word, "grp": grp, "part": part,
        "n_train": pa.array(np.add.reduceat(columns[1].astype(np.int64) % 2, starts)),
        "rows": _binary(flat, np.append(starts, len(rows)) * (8 * len(columns)))})


def _some(batches: Iterator[pa.RecordBatch], n_columns: int, step: int) -> Iterator[tuple]:
    """(words, groups, parts, rows, where each term's rows start and end) of some terms of a batch at a time: up to about
    ``step`` rows, a longer term by itself.  A batch is let go before the next one is read."""
    for batch in batches:
        flat, ends = _bytes_of(batch["rows"])
        flat, ends = flat.view(np.int64), ends // 8
        n = np.diff(ends) // n_columns
        upto = np.cumsum(n)
        names = [batch[c].to_pylist() for c in ("word", "grp", "part")]
        lo = 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - n[lo] + step, "right")))
            own = n[lo:hi]
            starts = np.append(0, np.cumsum(own))
            if hi == lo + 1:
                rows = flat[ends[lo]:ends[hi]].reshape(n_columns, -1)
            else:
                place = np.repeat(ends[lo:hi] - starts[:-1], own) + np.arange(starts[-1])
                rows = flat[place + np.arange(n_columns)[:, None] * np.repeat(own, own)]
            yield (*(x[lo:hi] for x in names), rows, starts)
            rows = None
            lo = hi
        batch = flat = rows = None


def _weights_by_term(grp: list, groups: list[str], s: Setting) -> tuple[np.ndarray, np.ndarray]:
    """(weights by group, the last all zero; the group of each term)."""
    place = {g: i for i, g in enumerate(groups)}
    return np.vstack([s.weights, np.zeros(s.weights.shape[1])]), np.array([place.get(g, len(groups)) for g in grp])


def _steps(t: Terms, groups: list[str], s: Setting, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their terms, rows x lanes values) of the ``wanted`` rows, ``_step`` rows at a time."""
    weights, group = _weights_by_term(t.grp, groups, s)
    of = np.repeat(np.arange(len(t.word)), np.diff(t.starts))
    wanted = np.arange(len(of)) if wanted is None else wanted
    step = _step(s)
    for lo in range(0, len(wanted), step):
        at = wanted[lo:lo + step]
        yield at, of[at], _values(t.rows[:, at], weights[group[of[at]]], s)


def _terms(batches: Iterator[pa.RecordBatch], groups: list[str], s: Setting, hot: dict | None, steps: int = 1) -> Iterator[Terms]:
    """Terms with their class sums, those of about ``steps`` steps at a time; a long term's sums add up over its steps.

    ``hot`` holds the sums of terms dealt in parts; others are summed here, and all without it.
    """
    k = len(s.sizes)
    for word, grp, part, rows, starts in _some(batches, 3 + len(groups), steps * _step(s)):
        t = Terms(word, grp, part, np.zeros((len(word), k, s.weights.shape[1]), np.int64), rows, starts,
                  np.logical_or.reduceat(rows[1] % 2 == 1, starts[:-1]), np.ones(len(word), bool))
        # training rows by term and class: the sums of a step's runs are all there is to add
        of = np.repeat(np.arange(len(word)), np.diff(starts))
        train = np.flatnonzero((rows[1] % 2 == 1) & (rows[1] >= 0))
        order = train[np.argsort(of[train] * k + rows[1, train] // 2, kind="stable")]
        for at, of_at, values in _steps(t, groups, s, order):
            run = of_at * k + rows[1, at] // 2
            first = np.flatnonzero(np.diff(run, prepend=-1))
            t.sums.reshape(-1, t.sums.shape[2])[run[first]] += np.add.reduceat(_units(values), first, axis=0)
        for i in range(len(word)) if hot else ():
            if part[i] >= 0:
                sums, one = hot.get((word[i], grp[i]), (None, None))
                t.seen[i], t.once[i] = sums is not None, one == part[i]
                if sums is not None:
                    t.sums[i] = sums
        if hot is not None and not hot:
            t.seen[np.array(part) >= 0] = False
        yield t
        rows = t = None


class _Dots:
    """Sums by document over the terms of a task, handed on at ``DOT_BYTES`` and at its end."""

    def __init__(self):
        self.doc, self.dots, self.new, self.n_new = None, None, [], 0

    def add(self, doc: np.ndarray, dots: np.ndarray) -> None:
        """Sums of documents that are held already grow in place; others wait for ``merge``."""
        if (np.diff(doc) <= 0).any():
            doc, dots = _by_document(doc, dots)
        if self.doc is not None:
            at = np.searchsorted(self.doc, doc)
            known = self.doc[np.minimum(at, len(self.doc) - 1)] == doc
            self.dots[at[known]] += dots[known]
            doc, dots = doc[~known], dots[~known]
        if len(doc):
            self.new.append((doc, dots))
            self.n_new += len(doc)

    def merge(self) -> int:
        """Fold in what was added; the bytes that are held now."""
        if self.new:
            held = [(self.doc, self.dots)] if self.doc is not None else []
            doc, dots = zip(*held, *self.new)
            self.doc, self.dots = _by_document(np.concatenate(doc), np.concatenate(dots))
            self.new, self.n_new = [], 0
        return 0 if self.doc is None else self.dots.nbytes

    def due(self) -> bool:
        """Whether merging pays: new sums of a quarter of what is held."""
        return self.n_new >= max(32_768, 0 if self.doc is None else len(self.doc) // 4)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for lo in range(0, 0 if self.doc is None else len(self.doc), STEP):
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(self.doc[lo:lo + STEP]),
                "dots": pa.array([x.tobytes() for x in self.dots[lo:lo + STEP]], pa.binary())})
        self.doc = self.dots = None


def _range_of(doc: np.ndarray, ranges: int) -> np.ndarray:
    """The part of the documents, of ``ranges`` about equal ones, that each number belongs to."""
    mixed = doc.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(8)).astype(np.int64) % ranges


def _by_document(doc: np.ndarray, dots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document once, ascending, with the sum of its rows of ``dots``."""
    order = np.argsort(doc, kind="stable")
    first = np.flatnonzero(np.diff(doc[order], prepend=doc[order][:1] - 1))
    return doc[order][first], np.add.reduceat(dots[order], first, axis=0)


def _scores(sums: np.ndarray, s: Setting) -> np.ndarray:
    """terms x lanes: OCFS from class sums (terms x classes x lanes), in the order of ``ocfs_from_sums``."""
    n = s.sizes.sum()
    means = sums.astype(float) / UNIT
    overall = np.zeros(means.shape[::2])
    for c in range(len(s.sizes)):
        overall = overall + means[:, c]
    overall = overall / n
    score = np.zeros_like(overall)
    for c, size in enumerate(s.sizes):
        d = means[:, c] / size - overall
        score = score + 1000.0 * (size / n) * d * d
    return score


def _ranked(buckets: list[tuple], rank: int) -> tuple[int, int, int]:
    """(least, most, rank among them) of where the value of a rank lies; the ends of a bucket are known."""
    for n, least, most in buckets:
        if rank < n:
            if rank == 0 or least == most:
                return least, least, 0
            return (most, most, 0) if rank == n - 1 else (least, most, rank)
        rank -= n
    raise ValueError("fewer values than the rank")


class Weightings:
    """The term rows of a corpus and the passes over them for one set of weightings."""

    def __init__(self, docs: DataFrame, combos: list[dict], groups: list[str], sizes: dict, rows: DataFrame | None = None):
        self.docs, self.groups, self.combos = docs, list(groups), combos
        labels = sorted(sizes)
        self.setting = Setting(np.array([[float(w.get(g, 0.0)) for w in combos] for g in self.groups]),
                               np.array([float(sizes[x]) for x in labels]), labels)
        self.rows = rows if rows is not None else term_rows(docs, self.groups, labels)
        self.hot = self._hot_sums()
        self.profile: Profile | None = None

    def _pass(self, consume: Callable, schema: str, rows: DataFrame | None = None) -> DataFrame:
        """``consume`` over the terms of every task."""
        groups, s, hot = self.groups, self.setting, getattr(self, "hot", None)
        return (self.rows if rows is None else rows).mapInArrow(
            lambda batches: consume(_terms(batches, groups, s, hot), s), schema)

    def _hot_sums(self) -> dict:
        """Class sums and first part of the terms dealt in parts: at most one per ``HOT_ROWS`` rows of the corpus."""
        rows = self.rows.where("part >= 0 and n_train > 0")

        def consume(terms, s):
            for t in terms:
                yield pa.RecordBatch.from_pydict({"word": t.word, "grp": t.grp, "part": pa.array(t.part, pa.int64()),
                                                  "sums": [x.tobytes() for x in t.sums]})

        shape = (len(self.setting.sizes), self.setting.weights.shape[1])
        out: dict = {}
        for r in self._pass(consume, "word string, grp string, part long, sums binary", rows).toLocalIterator():
            sums, first = out.get((r["word"], r["grp"]), (0, r["part"]))
            out[r["word"], r["grp"]] = (sums + np.frombuffer(r["sums"], np.int64).reshape(shape), min(first, r["part"]))
        return out

    def _lanes(self, lanes: np.ndarray) -> Weightings:
        """The same rows for some of the weightings, by number; one may come several times."""
        some = copy.copy(self)
        some.combos, some.setting = [self.combos[i] for i in lanes], self.setting._replace(weights=self.setting.weights[:, lanes])
        some.hot = {term: (sums[:, lanes], part) for term, (sums, part) in self.hot.items()}
        if self.profile:
            some.profile = Profile(self.profile.n_terms, [self.profile.buckets[i] for i in lanes], self.profile.norms[:, lanes])
        return some

    def _profiled(self) -> Profile:
        """What does not depend on a cut, found in one pass and kept."""
        if self.profile is None:
            found, norms = self._histogram(np.zeros(len(self.combos), np.int64), np.full(len(self.combos), INFINITE), True)
            buckets = [found.get(i, []) for i in range(len(self.combos))]
            self.profile = Profile(sum(n for n, _, _ in buckets[0]) if buckets else 0, buckets, norms)
        return self.profile

    def _least(self) -> np.ndarray:
        """The least score of every weighting."""
        return np.array([found[0][1] if found else 0 for found in self._profiled().buckets], np.int64).view(np.float64)

    # -- OCFS ------------------------------------------------------------------------------

    def top_terms(self, k: int) -> DataFrame:
        """``combo_id, word, grp, score, rank``: the ``k`` best features of every weighting, by the
        score rounded to 6 places, then by name."""
        lanes = len(self.combos)

        def consume(terms, s):
            # What is at least the k-th best score so far, as (lane, score, term) pieces; now and then only the best stay.
            floor, best, held, n = np.full(lanes, -np.inf), [], [], 0

            def settle():
                named: list[list[tuple]] = [[] for _ in range(lanes)]
                for lane, x in best:
                    named[lane].append(x)
                lane, score = (np.concatenate(x) if held else np.zeros(0) for x in (zip(*[(h[0], h[1]) for h in held]) if held else ((), ())))
                names = [x for h in held for x in h[2]]
                order = np.argsort(lane, kind="stable")
                ends = np.searchsorted(lane[order], np.arange(lanes + 1))
                out = []
                for i in range(lanes):
                    at = order[ends[i]:ends[i + 1]]
                    if len(at) > k:
                        column = score[at]
                        at = at[column >= np.partition(column, len(at) - k)[len(at) - k]]
                    kept = sorted({*named[i], *((-score[j], *names[j]) for j in at)})[:k]
                    if len(kept) == k:
                        floor[i] = -kept[-1][0]
                    out += [(i, x) for x in kept]
                return out

            for t in terms:
                mine = np.flatnonzero(t.seen & t.once)
                if not len(mine):
                    continue
                score = np.floor(_scores(t.sums[mine], s) * 1e6 + 0.5) / 1e6
                at, lane = np.nonzero(score >= floor)
                if len(at):
                    held.append((lane, score[at, lane], [(t.word[i], t.grp[i]) for i in mine[at]]))
                    n += len(at)
                if n > 1000 * lanes:
                    best, held, n = settle(), [], 0
            flat = [(lane, *x) for lane, x in settle()]
            if flat:
                lane, score, word, grp = zip(*flat)
                yield pa.RecordBatch.from_pydict({"combo_id": pa.array(lane, pa.int64()), "word": list(word), "grp": list(grp),
                                                  "score": pa.array([-x for x in score], pa.float64())})

        found = self._pass(consume, "combo_id long, word string, grp string, score double").distinct()
        w = Window.partitionBy("combo_id").orderBy(F.desc("score"), "word", "grp")
        return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)

    def cuts(self, n_delete: int) -> np.ndarray:
        """D12 for every weighting: the exact linear percentile of its scores, by histogram refinement.

        Scores are not negative, so their bit patterns order like they do; buckets of equal width
        in the patterns suit scores that spread over many magnitudes.  The first pass is shared by all cuts."""
        lanes, profile = len(self.combos), self._profiled()
        h = L.percentile_rank(n_delete, profile.n_terms) / 100.0 * (profile.n_terms - 1)
        ranks = (int(h // 1), int(-(-h // 1)))
        value = np.zeros((lanes, 2), np.int64)
        low, high, left = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), {}
        found = dict(enumerate(profile.buckets))
        rank = {lane: ranks for lane in range(lanes)}
        while found:
            for lane, buckets in found.items():
                places = [_ranked(buckets, r) for r in rank.pop(lane)]
                for i, (least, most, _) in enumerate(places):
                    value[lane, i] = least
                if any(least != most for least, most, _ in places):    # then both lie in one bucket
                    (least, most, _), = {(p[0], p[1], 0) for p in places if p[0] != p[1]}
                    low[lane], high[lane] = least, most
                    left[lane] = tuple(p[2] for p in places)
            rank, left = left, {}
            found = {}
            if rank:
                open_lanes = np.array(sorted(rank))
                some = self._lanes(open_lanes)
                got, _ = some._histogram(low[open_lanes], high[open_lanes])
                found = {int(open_lanes[i]): buckets for i, buckets in got.items()}
        lower, upper = value[:, 0].copy().view(np.float64), value[:, 1].copy().view(np.float64)
        if ranks[0] == ranks[1]:
            return lower
        return np.where(lower == upper, lower, lower + (upper - lower) * (h - ranks[0]))

    def _histogram(self, low: np.ndarray, high: np.ndarray, norms: bool = False) -> tuple[dict[int, list[tuple]], np.ndarray]:
        """Per lane (values, least, most) of the filled buckets of [low, high], as bit patterns, ascending; and with ``norms``,
        classes x lanes, the squared length of the class means over all terms."""
        k, lanes = len(self.setting.sizes), len(low)

        def consume(terms, s):
            # buckets as wide as the least power of two that gives no more than BUCKETS
            width = np.array([int(x).bit_length() for x in (high - low) // BUCKETS])
            base, whole = np.arange(lanes) * BUCKETS, not low.any() and (high == INFINITE).all()
            n = np.zeros(lanes * BUCKETS, np.int64)
            least, most = np.full(n.shape, np.iinfo(np.int64).max), np.full(n.shape, -1)
            length = np.zeros((k, lanes))
            for t in terms:
                mine = t.seen & t.once
                sums = t.sums if mine.all() else t.sums[mine]
                v = np.ascontiguousarray(_scores(sums, s)).view(np.int64)
                at = ((v - low) >> width) + base
                if whole:
                    at, v = at.ravel(), v.ravel()
                else:
                    inside = (v >= low) & (v <= high)
                    at, v = at[inside], v[inside]
                n += np.bincount(at, minlength=len(n)) if len(at) > len(n) // 4 else 0
                if len(at) <= len(n) // 4:
                    np.add.at(n, at, 1)
                np.minimum.at(least, at, v)
                np.maximum.at(most, at, v)
                if norms:
                    means = sums / UNIT
                    means /= s.sizes[:, None]
                    length += np.einsum("tkl,tkl->kl", means, means)
            at = np.flatnonzero(n)
            flat = length.ravel() if norms else np.zeros(0)
            none = np.zeros(len(flat), np.int64)
            yield pa.RecordBatch.from_pydict({
                "lane": pa.array(np.append(at // BUCKETS, np.arange(len(flat)) % lanes)),
                "bucket": pa.array(np.append(at % BUCKETS, -1 - np.arange(len(flat)) // lanes)),
                "n": pa.array(np.append(n[at], none)), "least": pa.array(np.append(least[at], none)),
                "most": pa.array(np.append(most[at], none)), "x": pa.array(np.append(np.zeros(len(at)), flat))})

        got = self._pass(consume, "lane long, bucket long, n long, least long, most long, x double").groupBy("lane", "bucket").agg(
            F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("x").alias("x"))
        out: dict[int, list[tuple]] = {}
        total = np.zeros((k, lanes))
        for r in sorted(got.collect(), key=lambda r: (r["lane"], r["bucket"])):  # lanes x BUCKETS rows
            if r["bucket"] < 0:
                total[-1 - r["bucket"], r["lane"]] = r["x"]
            else:
                out.setdefault(r["lane"], []).append((r["n"], r["least"], r["most"]))
        return out, total

    def feature_counts(self, cut: np.ndarray) -> DataFrame:
        """``combo_id, n_features, n_kept`` of every weighting; there is nothing to count where no score is below its cut."""
        if (cut <= self._least()).all() and self._profiled().n_terms:
            n = self._profiled().n_terms
            return self.docs.sparkSession.createDataFrame([(i, n, n) for i in range(len(cut))], "combo_id long, n_features long, n_kept long")

        def consume(terms, s):
            n, kept = 0, np.zeros(len(cut), np.int64)
            for t in terms:
                mine = t.seen & t.once
                n += int(mine.sum())
                kept += (_scores(t.sums[mine], s) >= cut).sum(axis=0)
            yield pa.RecordBatch.from_pydict({"combo_id": pa.array(np.arange(len(cut))), "n_features": pa.array([n] * len(cut)),
                                              "n_kept": pa.array(kept)})

        return self._pass(consume, "combo_id long, n_features long, n_kept long") \
            .groupBy("combo_id").agg(F.sum("n_features").alias("n_features"), F.sum("n_kept").alias("n_kept"))

    # -- nearest-centroid runs -------------------------------------------------------------

    def _norms(self, cut: np.ndarray) -> np.ndarray:
        """classes x lanes: squared length of the class means over the kept terms."""
        out, some = self._profiled().norms.copy(), np.flatnonzero(cut > self._least())
        if len(some):
            out[:, some] = self._lanes(some)._kept_norms(cut[some])
        return out

    def _kept_norms(self, cut: np.ndarray) -> np.ndarray:
        shape = (len(self.setting.sizes), len(cut))

        def consume(terms, s):
            out = np.zeros(shape)
            for t in terms:
                sums = t.sums[t.seen & t.once]
                means = sums / UNIT / s.sizes[:, None]
                out += (np.square(means) * (_scores(sums, s) >= cut)[:, None, :]).sum(axis=0)
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(out.size)), "x": pa.array(out.ravel())})

        got = self._pass(consume, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        flat = np.zeros(shape[0] * shape[1])
        for r in got:  # classes x lanes rows
            flat[r["at"]] = r["x"]
        return flat.reshape(shape)

    def confusions(self, cut: np.ndarray) -> DataFrame:
        """``combo_id, split, label, prediction, n``: nearest class centroid of every document, over the
        kept terms: least squared length of the class mean minus twice the dot product, rounded to
        9 places, ties to the alphabetically first class.  ``DOT_SENT`` and ``DOT_BYTES`` set the weightings of a
        pass; what the driver holds is the counts."""
        spark = self.docs.sparkSession
        k, n_docs, rows = len(self.setting.sizes), self.docs.count(), []
        tasks = max(1, min(DOT_TASKS, spark.sparkContext.defaultParallelism))
        width = max(1, min(DOT_LANES, DOT_SENT // (8 * k * tasks), DOT_BYTES // 2 // max(1, 8 * k * n_docs)))
        width = -(-len(cut) // -(-len(cut) // width))
        ranges = -(-n_docs * 8 * k * min(width, len(cut)) // (DOT_BYTES // 2)) or 1
        with _shuffles_dropped(spark):
            norms = self._norms(cut)
            for at in range(0, len(cut), width):
                some = self._lanes(np.arange(at, min(at + width, len(cut))))._confusions(cut[at:at + width], norms[:, at:at + width], tasks, ranges)
                rows += [(r["combo_id"] + at, *tuple(r)[1:]) for r in some.collect()]
        return spark.createDataFrame(rows, "combo_id long, split string, label string, prediction string, n long")

    def _dots(self, cut: np.ndarray, tasks: int, ranges: int, mine: int) -> DataFrame:
        """``doc_id, dots``: what the terms of each of ``tasks`` add to the distances of the ``mine``-th of ``ranges`` of documents."""
        groups, s, hot = self.groups, self.setting, self.hot
        # A weighting's class sums and distances are found once, at its least cut; what its other cuts delete besides is taken off.
        _, own, lane = np.unique(s.weights, axis=1, return_index=True, return_inverse=True)
        lane = lane.ravel()
        base = np.full(len(own), np.inf)
        np.minimum.at(base, lane, cut)
        more = np.flatnonzero(cut > base[lane])
        s = s._replace(weights=s.weights[:, own])
        hot = {term: (sums[:, own], part) for term, (sums, part) in hot.items()}
        k = len(s.sizes)

        def added(batches):
            held = _Dots()
            for t in _terms(batches, groups, s, hot, DOT_STEPS):
                # a document's weights come off in the end: its distance is a sum of count * weight * mean, divided by its total
                score = _scores(t.sums, s)
                kept = score >= base
                weights, group = _weights_by_term(t.grp, groups, s)
                means = t.sums / UNIT
                means /= s.sizes[:, None]
                means *= weights[group][:, None, :]
                less = kept[:, lane[more]] & (score[:, lane[more]] < cut[more])
                fewer, touched = means[:, :, lane[more]] * less[:, None, :], less.any(axis=1)
                means *= kept[:, None, :]
                some = np.repeat(t.seen & (group < len(groups)), np.diff(t.starts))   # terms of other groups have no value
                if ranges > 1:
                    some &= _range_of(t.rows[0], ranges) == mine
                some = np.flatnonzero(some)
                some = some[np.argsort(t.rows[0, some], kind="stable")]
                of = np.repeat(np.arange(len(t.word)), np.diff(t.starts))[some]
                means, fewer = means.reshape(len(means), -1), fewer.reshape(len(means), -1)
                for lo in range(0, len(some), _step(s)):
                    at, term = some[lo:lo + _step(s)], of[lo:lo + _step(s)]
                    doc, cnt = t.rows[0, at], t.rows[2, at].astype(float)
                    new = np.diff(doc, prepend=doc[0] - 1) != 0
                    first = np.flatnonzero(new)
                    total = t.rows[3:, at[first]].T.astype(float) @ s.weights
                    total[~(total > 0)] = 1.0
                    x = means[term]
                    x *= cnt[:, None]
                    dots = np.add.reduceat(x, first, axis=0).reshape(len(first), k, -1)
                    dots /= total[:, None, :]
                    dots = dots[:, :, lane]
                    off = np.flatnonzero(touched[term])
                    if len(off):
                        place = (np.cumsum(new) - 1)[off]
                        run = np.flatnonzero(np.diff(place, prepend=-1))
                        y = np.add.reduceat(fewer[term[off]] * cnt[off, None], run, axis=0).reshape(len(run), k, -1)
                        dots[np.ix_(place[run], np.arange(k), more)] -= y / total[place[run]][:, None, lane[more]]
                    held.add(doc[first], dots)
                    if held.due() and held.merge() > DOT_BYTES:
                        yield from held.batches()
            held.merge()
            yield from held.batches()

        return self.rows.coalesce(tasks).mapInArrow(added, "doc_id long, dots binary")

    def _confusions(self, cut: np.ndarray, norms: np.ndarray, tasks: int, ranges: int) -> DataFrame:
        labels = self.setting.labels
        k, lanes = norms.shape
        dots = reduce(DataFrame.unionByName, [self._dots(cut, tasks, ranges, i) for i in range(ranges)])
        base = self.docs.select("doc_id", "label", "split", F.lit(None).cast("binary").alias("dots"))
        both = base.unionByName(dots.select("doc_id", F.lit(None).cast("string").alias("label"),
                                            F.lit(None).cast("string").alias("split"), "dots"))

        def decide(batches):
            counts: dict[tuple, np.ndarray] = {}

            def close(gold, total):
                """Counts documents by their gold (split, label) and nearest class."""
                said = np.round(norms - 2.0 * total.reshape(-1, k, lanes), 9).argmin(axis=1)
                for one in {*gold}:
                    own = said[[g == one for g in gold]]
                    counts.setdefault(one, np.zeros((lanes, k), np.int64))[:] += np.stack([(own == c).sum(axis=0) for c in range(k)], axis=1)

            last, open_gold, open_total = None, None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                doc = batch["doc_id"].to_numpy()
                base = batch["dots"].is_null().to_numpy(zero_copy_only=False)
                sums = np.zeros((len(doc), k * lanes))
                sums[~base] = _bytes_of(batch["dots"].filter(pa.array(~base)))[0].view(np.float64).reshape(-1, k * lanes)
                new = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1))
                total = np.add.reduceat(sums, new, axis=0)
                gold: list = [None] * len(new)
                heads = np.flatnonzero(base)
                for i, split, label in zip(np.searchsorted(new, heads, "right") - 1, batch["split"].take(pa.array(heads)).to_pylist(),
                                           batch["label"].take(pa.array(heads)).to_pylist()):
                    gold[i] = (split, label)
                if last is not None and last == doc[0]:
                    total[0] += open_total
                    gold[0] = gold[0] or open_gold
                elif last is not None:
                    close([open_gold], open_total)
                close(gold[:-1], total[:-1])
                last, open_gold, open_total = doc[-1], gold[-1], total[-1].copy()
            if last is not None:
                close([open_gold], open_total)
            flat = [(lane, split, label, labels[c], int(n[lane, c])) for (split, label), n in counts.items()
                    for lane, c in zip(*np.nonzero(n))]
            if flat:
                lane, split, label, said, n = zip(*flat)
                yield pa.RecordBatch.from_pydict({"combo_id": pa.array(lane, pa.int64()), "split": list(split), "label": list(label),
                                                  "prediction": list(said), "n": pa.array(n, pa.int64())})

        parts = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = both.repartition(parts, "doc_id").sortWithinPartitions("doc_id")
        return dealt.mapInArrow(decide, "combo_id long, split string, label string, prediction string, n long") \
            .groupBy("combo_id", "split", "label", "prediction").agg(F.sum("n").alias("n"))


def in_passes(docs: DataFrame, combos: list[dict], groups: list[str], sizes: dict) -> Iterator[tuple[int, Weightings]]:
    """``Weightings`` of ``LANES`` combos at a time over the same written rows, with their first number."""
    rows = term_rows(docs, list(groups), sorted(sizes))
    for at in range(0, len(combos), LANES):
        yield at, Weightings(docs, combos[at:at + LANES], groups, sizes, rows)


def run_scores(confusion: DataFrame) -> DataFrame:
    """D13, D15 per weighting: ``combo_id, train_acc, test_acc, macro_f1`` from counts."""
    right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    acc = confusion.where(F.col("split") != "dev").groupBy("combo_id", "split").agg((right / F.sum("n")).alias("acc"))
    accs = acc.groupBy("combo_id").agg(F.max(F.when(F.col("split") == "train", F.col("acc"))).alias("train_acc"),
                                       F.max(F.when(F.col("split") == "test", F.col("acc"))).alias("test_acc"))
    rows = []
    for lab in REPORT_LABELS:
        gold, said = F.col("label") == lab, F.col("prediction") == lab
        cell = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
        rows.append(F.struct(F.lit(lab).alias("class"), cell(gold & said).alias("tp"), cell(said).alias("pp"),
                             cell(gold).alias("support")))
    per_class = confusion.where(F.col("split") == "test").groupBy("combo_id").agg(F.array(*rows).alias("_r")) \
        .select("combo_id", F.explode("_r").alias("r")).select("combo_id", "r.*")
    f1 = _prf(per_class, ["combo_id"]).groupBy("combo_id").agg(F.avg("f1").alias("macro_f1"))
    return accs.join(f1, "combo_id")


def grid_runs(docs: DataFrame, combos: list[dict], groups: list[str], sizes: dict, deletes: list[int]) -> DataFrame:
    """``n_delete, combo_id, train_acc, test_acc, macro_f1`` of every weighting and feature cut.  All cuts are scored
    in the same passes, equal ones of a weighting once."""
    out = None
    for at, w in in_passes(docs, combos, groups, sizes):
        cuts = {n: w.cuts(n) for n in deletes}
        own = {n: list(enumerate(np.maximum(cut, w._least()).tolist())) for n, cut in cuts.items()}   # a cut below all scores deletes nothing
        wanted = sorted({x for pairs in own.values() for x in pairs})
        place = {x: i for i, x in enumerate(wanted)}
        scored = cut_lineage(run_scores(w._lanes(np.array([lane for lane, _ in wanted])).confusions(np.array([cut for _, cut in wanted]))))
        runs = docs.sparkSession.createDataFrame([(place[x], n, x[0] + at) for n, pairs in own.items() for x in pairs],
                                                 "at long, n_delete long, combo_id long")
        part = cut_lineage(runs.join(scored.withColumnRenamed("combo_id", "at"), "at")
                           .select("n_delete", "combo_id", "train_acc", "test_acc", "macro_f1"))
        out = part if out is None else out.unionByName(part)
    return out
