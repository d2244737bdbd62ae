"""The corpus pipeline, stage by stage, against brute force; the entry point without the subpackage."""

import collections
import importlib
import sys

import pytest

import corpus_pipeline
from tagweave.llm import secret_scan
from tests.llm.cases import CLASHING, documents, empty, frame
from tests.llm.test_duplicates import groups_by_hand
from tests.llm.test_filters import counts_by_hand
from tests.llm.test_tokens import check_packing, word_bpe  # noqa: F401 - a fixture


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows = documents(spark)
    frame(spark, rows).write.parquet(str(path / "documents.parquet"))
    return str(path), rows


def test_stages_by_brute_force(spark, folder, word_bpe):  # noqa: F811
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "packing":
            assert out.columns == docs.columns
        kept[name] = (docs, out.cache())
        docs = out
    before, after = kept["language_id"]
    gone = rows_of(before) - rows_of(after)
    assert not rows_of(after) - rows_of(before)
    text = before.columns.index("text")
    assert all(any(c.isalpha() for c in r[text] or "") for r in rows_of(after))
    assert sum(gone.values()) <= 0.2 * before.count()
    before, after = kept["quality_rules"]
    assert not rows_of(after) - rows_of(before)
    failed = {r for r in rows_of(before) if counts_by_hand(r[text])[-1]}
    assert not failed & set(rows_of(after))
    before, after = kept["near_dedup"]
    rows = [r.asDict() for r in before.collect()]
    want = groups_by_hand(rows, 5)
    assert rows_of(after) == collections.Counter({r: n for r, n in rows_of(before).items() if want[r[0]] == r[0]})
    before, after = kept["secret_scan"]
    columns = before.columns
    redacted = collections.Counter()
    for r, n in rows_of(before).items():
        d = dict(zip(columns, r))
        d["text"] = secret_scan.redact_text(d["text"])
        d["n_chars"] = len(d["text"])
        redacted[tuple(d[c] for c in columns)] += n
    assert rows_of(after) == redacted
    before, after = kept["packing"]
    check_packing([r.asDict() for r in before.collect()], after.collect(), word_bpe)


def test_run_applies_the_stages_in_order(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows_of(corpus_pipeline.run(spark, path).select(key)) == rows_of(docs.select(key))


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_extra_columns_are_carried():
    assert {"score", "kept", "piece"} <= set(CLASHING)


def test_entry_point_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry
    whole = set(entry.queries())
    assert {"pipeline", "op1_packing", "op10_bpe_codec"} <= whole
    for missing in ("corpus_pipeline", "tagweave.llm.queries"):
        with monkeypatch.context() as m:
            m.setitem(sys.modules, missing, None)  # an import of it now fails as if it were not there
            left = set(entry.queries())
            assert left and not any(q.startswith("op") and q[2].isdigit() for q in left) and "pipeline" not in left
            assert not set(entry.oracle_sql()) - left
    importlib.reload(entry)
    assert set(entry.queries()) == whole
