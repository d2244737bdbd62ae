"""How often the term rows are read, and what a task makes of a batch of documents."""

import numpy as np
import pyarrow as pa
import pytest

from tagweave.operators import longform as L
from tagweave.operators import weightings as W

COMBOS = [{"N": 1, "V": 1}, {"N": 1, "V": 3}, {"N": 2, "V": 1}]
SCHEMA = "doc_id long, label string, split string, terms array<struct<word:string,grp:string>>"


@pytest.fixture(scope="module")
def docs(spark):
    terms = [(f"w{i % 17}", "NV"[i % 2]) for i in range(40)]
    return spark.createDataFrame([(i, "negative positive".split()[i % 2], "train" if i < 20 else "test", terms[i % 23:])
                                  for i in range(30)], SCHEMA).persist()


def test_many_documents_take_more_passes_not_more_readings_of_a_pass(docs, monkeypatch):
    """A pass has as many weightings as its documents' sums leave room for; the rows are read once by each."""
    w = W.Weightings(docs, COMBOS, ["N", "V"], L.class_sizes(docs))
    order = ["combo_id", "split", "label", "prediction"]
    want = w.confusions(np.zeros(3)).orderBy(*order).collect()
    dots, seen = W.Weightings._dots, []

    def counted(self, cut, tasks, ranges, mine):
        seen.append((len(cut), ranges))
        return dots(self, cut, tasks, ranges, mine)

    monkeypatch.setattr(W.Weightings, "_dots", counted)
    monkeypatch.setattr(W, "DOT_BYTES", 2 * 8 * 2 * 30)
    assert w.confusions(np.zeros(3)).orderBy(*order).collect() == want
    assert seen == [(1, 1)] * 3


def test_cuts_share_the_first_pass_and_equal_ones_are_scored_once(docs, monkeypatch):
    histogram, confusions, seen, scored = W.Weightings._histogram, W.Weightings.confusions, [], []

    def counted(self, *args):
        seen.append(len(self.combos))
        return histogram(self, *args)

    def lanes(self, cut):
        scored.append(len(cut))
        return confusions(self, cut)

    monkeypatch.setattr(W.Weightings, "_histogram", counted)
    monkeypatch.setattr(W.Weightings, "confusions", lanes)
    got = W.grid_runs(docs, COMBOS, ["N", "V"], L.class_sizes(docs), [0, 0]).collect()
    assert {(r["n_delete"], r["combo_id"]) for r in got} == {(0, 0), (0, 1), (0, 2)}
    assert seen == [3] and scored == [3]


def test_a_batch_of_documents_leaves_one_row_a_term():
    kind = pa.list_(pa.struct([("word", pa.string()), ("grp", pa.string())]))
    a, b = {"word": "a", "grp": "N"}, {"word": "b", "grp": "X"}
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([-5, 2**40, 7, 8]), "code": pa.array([1, 2, 1, 1], pa.int32()),
                                        "terms": pa.array([[a, b, a], [a], None, []], kind)})
    (piece,) = W._pieces(iter([batch]), ["V", "N"])
    assert piece.select(["word", "grp", "n", "first"]).to_pylist() == [
        {"word": "a", "grp": "N", "n": 2, "first": -5}, {"word": "b", "grp": "X", "n": 1, "first": -5}]
    rows, ends = W._bytes_of(piece["rows"])
    packed = W._packed([["a", "b"], ["N", "X"], [-1, -1]], rows.view(np.int32).reshape(-1, 6), (ends[:-1] // 24).tolist())
    assert packed["n_train"].to_pylist() == [1, 1]
    shown = [np.frombuffer(x, np.int64).reshape(5, -1).T.tolist() for x in packed["rows"].to_pylist()]
    assert shown == [[[-5, 1, 2, 0, 2], [2**40, 2, 1, 0, 1]], [[-5, 1, 1, 0, 2]]]


def test_documents_are_counted_some_at_a_time(docs, monkeypatch):
    key = ["word", "grp"]
    want = {tuple(r)[:2]: r["n_train"] for r in W.term_rows(docs, ["N", "V"], ["negative", "positive"]).collect()}
    monkeypatch.setattr(W, "COUNTED", 50)
    got = W.term_rows(docs, ["N", "V"], ["negative", "positive"])
    assert {tuple(r)[:2]: r["n_train"] for r in got.collect()} == want
    assert got.select(*key).distinct().count() == got.count()
