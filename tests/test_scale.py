"""What a task or a document holds stays bounded, however frequent a term or long a text."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tagweave.functions import cleaning as C
from tagweave.operators import longform as L
from tagweave.operators import weightings as W
from tagweave.plans import queries as Q


def test_a_frequent_term_is_worked_on_in_steps(monkeypatch):
    rows = np.stack([np.arange(100), np.ones(100), np.ones(100), np.full(100, 4)]).astype(np.int64)
    batch = pa.RecordBatch.from_pydict({"word": ["the"], "grp": ["N"], "part": pa.array([-1], pa.int32()),
                                        "n_train": [100], "rows": pa.array([rows.tobytes()], pa.binary())})
    seen, values = [], W._values

    def counted(rows, own, s):
        seen.append(rows.shape[1])
        return values(rows, own, s)

    monkeypatch.setattr(W, "STEP", 8)
    monkeypatch.setattr(W, "_values", counted)
    (t,) = W._terms(iter([batch]), ["N"], W.Setting(np.array([[1.0, 2.0]]), np.array([100.0]), ["x"]), None)
    assert max(seen) <= 8 and sum(seen) == 100
    assert t.sums.tolist() == [[[25 * 10**12, 25 * 10**12]]]


def test_a_task_hands_on_one_sum_per_document():
    held = W._Dots()
    for term in range(50):
        held.add(np.array([3, 1, 2]), np.full((3, 1, 2), float(term)))
    assert held.merge() == 3 * 2 * 8
    (batch,) = held.batches()
    assert batch["doc_id"].to_pylist() == [1, 2, 3]
    assert [np.frombuffer(x).tolist() for x in batch["dots"].to_pylist()] == [[1225.0, 1225.0]] * 3
    assert not list(held.batches())


def test_idf_counts_runs_instead_of_comparing_all_pairs(spark):
    a, b = ("a", "N"), ("b", "V")
    docs = spark.createDataFrame([(1, "train", [a, b, a, None]), (2, "train", [a]), (3, "test", [b]), (4, "train", None), (5, "train", [])],
                                 "doc_id long, split string, terms array<struct<word:string,grp:string>>")
    got = L.idf(docs)
    assert {(r["word"], r["grp"]): r["df"] for r in got.collect()} == {a: 2, b: 1}
    assert "array_distinct" not in got._jdf.queryExecution().toString()


def test_the_cleaning_chain_does_not_repeat_itself():
    assert len(str(C.clean_text(F.col("text")))) < 20_000


def test_weight_grids_make_no_row_per_weighting(monkeypatch):
    """The grids of both scales go through the shared passes."""
    def never(*args, **kwargs):
        raise AssertionError("one row per weighting and term")

    called = []
    monkeypatch.setattr(Q.V, "grid_values", never)
    monkeypatch.setattr(Q.L, "ocfs_grid", never)
    monkeypatch.setattr(Q, "prepared", lambda spark, sf_dir: None)
    monkeypatch.setattr(Q.L, "class_sizes", lambda docs: {})

    class Passes(Exception):
        pass

    def passes(docs, combos, groups, sizes):
        called.append(len(combos))
        raise Passes

    monkeypatch.setattr(Q.W, "in_passes", passes)
    for query in (Q.q_weight_grid, Q.q_ocfs_grid):
        try:
            query(None, "")
        except Passes:
            pass
    assert called == [len(Q.GRID)] * 2


def test_distances_leave_as_many_tasks_as_run_at_a_time(spark, monkeypatch):
    """What is handed on grows with the documents, not with the tasks the term rows lie in; ranges of documents change nothing."""
    terms = [(f"w{i % 17}", "N") for i in range(40)]
    docs = spark.createDataFrame([(i, "negative positive".split()[i % 2], "train", terms[i % 23:]) for i in range(30)],
                                 "doc_id long, label string, split string, terms array<struct<word:string,grp:string>>")
    rows = W.term_rows(docs, ["N"], ["negative", "positive"]).repartition(16, "word")
    w = W.Weightings(docs, [{"N": 1}], ["N"], {"negative": 15, "positive": 15}, rows.localCheckpoint())
    cut = np.zeros(1)
    want = w.confusions(cut).orderBy("label", "prediction").collect()
    assert w._dots(cut, 2, 1, 0).count() <= 2 * 30
    assert sum(w._dots(cut, 2, 5, i).count() for i in range(5)) <= 2 * 30
    monkeypatch.setattr(W, "DOT_BYTES", 64)
    monkeypatch.setattr(W, "DOT_TASKS", 2)
    assert w.confusions(cut).orderBy("label", "prediction").collect() == want


def test_rows_of_a_batch_are_views_that_are_let_go():
    """A task holds a batch once, and none while it waits for the next."""
    import gc
    import weakref
    rows = np.stack([np.arange(50), np.ones(50), np.ones(50), np.full(50, 4)]).astype(np.int64)
    open_batches = []

    def batches():
        for i in range(3):
            gc.collect()
            assert not [r for r in open_batches if r() is not None]
            batch = pa.RecordBatch.from_pydict({"word": [f"w{i}", f"x{i}"], "grp": ["N", "N"], "part": pa.array([-1, -1], pa.int32()),
                                                "n_train": [50, 50], "rows": pa.array([rows.tobytes()] * 2, pa.binary())})
            open_batches.append(weakref.ref(batch))
            yield batch
            del batch

    got = [t.word for t in W._terms(batches(), ["N"], W.Setting(np.array([[1.0]]), np.array([50.0]), ["x"]), None)]
    assert got == [["w0", "x0"], ["w1", "x1"], ["w2", "x2"]]
