"""Raw readers and sinks (A1-A3, A5-A10)."""

from pyspark.sql import functions as F

from tagweave.sources import raw, sinks


def _write(p, text):
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_read_raw_modes(spark, tmp_path):
    lines = ['1\tpositive\tgood day', '2\tnegative\t"unclosed quote starts here', '3\tneutral\tplain text',
             '4\tpositive\tanother "quoted" word\textra']
    path = _write(tmp_path / "a.txt", "\n".join(lines) + "\n")
    line = raw.read_raw(spark, path, "line")
    assert line.count() == 4
    assert line.where("id = '4'").first()["to_delete"] == "extra"
    quoted = raw.read_raw(spark, path, "quoted")
    # the unclosed quote swallows the following line: fewer records, one holding a tab
    assert quoted.count() < 4
    assert quoted.where(F.col("text").contains("\t")).count() >= 1


def test_multi_file_read_is_a_union(spark, tmp_path):
    _write(tmp_path / "x1.txt", "1\tpositive\ta\n")
    _write(tmp_path / "x2.txt", "2\tnegative\tb\n3\tneutral\tc\n")
    df = raw.read_raw(spark, str(tmp_path / "x*.txt"))
    assert df.count() == 3 and df.select("source_file").distinct().count() == 2


def test_labelled_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "positive", 'he said "hi", then left'), (1, "negative", "line\nbreak")],
                               "row_index long, label string, text string")
    out = str(tmp_path / "shuffled")
    sinks.write_labelled(df, out)
    back = raw.read_labelled(spark, out).orderBy("doc_pos").collect()
    assert [(r["doc_pos"], r["label"], r["text"]) for r in back] == [
        (0, "positive", 'he said "hi", then left'), (1, "negative", "line\nbreak")]
    labels = raw.read_labels(spark, out, 1, None).collect()
    assert [(r["doc_pos"], r["label"]) for r in labels] == [(1, "negative")]


def test_text_lines_with_bom(spark, tmp_path):
    path = _write(tmp_path / "t.txt", "﻿first line\nsecond line\n")
    rows = raw.read_text_lines(spark, path).orderBy("doc_pos").collect()
    assert [(r["doc_pos"], r["text"]) for r in rows] == [(0, "first line"), (1, "second line")]


def test_saved_runs_round_trip(spark, tmp_path):
    runs = spark.createDataFrame([(0, "A:1", 0.9, 0.6, 0.5, "d", "A_scale_1", "f1"), (1, "A:2", 0.8, 0.7, 0.6, "d", "A_scale_1", "f1"),
                                  (0, "A:1", 0.9, 0.6, 0.5, "d", "A_scale_1", "accuracy")],
                                 "combo_id long, weights string, train_acc double, test_acc double, "
                                 "macro_f1 double, dataset string, experiment string, metric string")
    out = str(tmp_path / "runs")
    sinks.save_runs(runs, out)
    sinks.save_runs(runs, out)  # saved twice: still one copy
    back = sinks.read_runs(spark, out)
    assert sorted(map(tuple, back.select(runs.columns).collect())) == sorted(map(tuple, runs.collect()))
    # another experiment leaves the first alone; a new list replaces its own partition only
    sinks.save_runs(runs.where("metric = 'f1'").limit(1).withColumn("experiment", F.lit("B")), out)
    sinks.save_runs(runs.where("metric = 'accuracy'").withColumn("test_acc", F.lit(0.1)), out)
    got = {(r["experiment"], r["metric"], r["combo_id"]): r["test_acc"] for r in sinks.read_runs(spark, out).collect()}
    assert len(got) == 4 and got["A_scale_1", "accuracy", 0] == 0.1 and got["A_scale_1", "f1", 1] == 0.7


def test_order_follows_paths_not_sizes(spark, tmp_path):
    from tagweave.sources import conll
    (tmp_path / "t").mkdir()
    (tmp_path / "c").mkdir()
    for name, words in (("a.txt", ["a0", "a1"]), ("b.txt", [f"b{i}" * 50 for i in range(40)])):
        _write(tmp_path / "t" / name, "\n".join(words) + "\n")
        _write(tmp_path / "c" / name, "\n\n".join(f"{w}\tN" for w in words) + "\n\n")
    want = ["a0", "a1"] + [f"b{i}" * 50 for i in range(40)]
    lines = raw.read_text_lines(spark, str(tmp_path / "t")).orderBy("doc_pos").collect()
    assert [r["text"] for r in lines] == want
    docs = conll.read_conll(spark, str(tmp_path / "c")).orderBy("doc_pos").collect()
    assert [r["tokens"][0]["word"] for r in docs] == want
    assert [r["doc_pos"] for r in docs] == list(range(42))


def test_bom_is_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([(0, "positive", 'a "b"'), (1, "neutral", "c")],
                               "row_index long, label string, text string").coalesce(1)
    out = tmp_path / "bom"
    sinks.write_labelled(df, str(out))
    data = b"".join(p.read_bytes() for p in out.glob("part-*"))
    assert data.startswith(b'\xef\xbb\xbf"0","positive","a ""b"""\n')
    back = raw.read_labelled(spark, str(out)).orderBy("doc_pos").collect()
    assert [(r["doc_pos"], r["text"]) for r in back] == [(0, 'a "b"'), (1, "c")]


def test_text_and_parquet_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x\ny"), (2, "z")], "doc_id long, text string")
    sinks.write_text_only(df, str(tmp_path / "t"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["x y", "z"]
    sinks.write_cleaned(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_result_lists_by_first_line(spark, tmp_path):
    (tmp_path / "r" / "deep").mkdir(parents=True)
    _write(tmp_path / "r" / "AV_scale_3_accuracy.txt", "({'A': 2, 'V': 1}, 0.91, 0.65, 0.6)\n({'A': 1, 'V': 1}, 0.9, 0.64, 0.7)\n")
    _write(tmp_path / "r" / "deep" / "AV_scale_3_f1.txt", "\n({'A': 1, 'V': 3}, 0.88, 0.6, 0.7012)\n")
    _write(tmp_path / "r" / "deep" / "empty_f1.txt", "")
    got = {r["run_name"]: r for r in sinks.read_result_lists(spark, str(tmp_path / "r")).collect()}
    assert set(got) == {"AV_scale_3_accuracy", "AV_scale_3_f1"}
    a, f = got["AV_scale_3_accuracy"], got["AV_scale_3_f1"]
    assert (a["metric"], a["weights"], a["train_acc"], a["test_acc"], a["macro_f1"]) == \
        ("accuracy", "{'A': 2, 'V': 1}", 0.91, 0.65, 0.6)
    assert (f["metric"], f["macro_f1"]) == ("f1", 0.7012)


def test_labels_join_only_equal_counts(spark, tmp_path):
    from tagweave.sources import conll
    path = _write(tmp_path / "t.txt", "a\tN\n\nb\tV\n\n")
    tokens = conll.read_conll(spark, path)
    labels = spark.createDataFrame([(0, "x"), (1, "y")], "doc_pos long, label string")
    joined = {r["label"]: r["tokens"][0]["word"] for r in conll.join_labels(tokens, labels).collect()}
    assert joined == {"x": "a", "y": "b"}
    try:
        conll.join_labels(tokens, labels.limit(1))
    except ValueError:
        return
    raise AssertionError("unequal counts must not be joined")


def test_quoted_files_split(spark, tmp_path):
    texts = ["plain", "two\nlines", 'a ""quoted"" word', "comma, here", "three\n\nblank\nlines", '""', "\n", "tab\tx",
             "é 日本", '""\n""', "ends with quote\"\"", "x" * 300]
    rows = [(i, ["positive", "negative"][i % 2], texts[i % len(texts)]) for i in range(600)]
    for name, n, end in (("a.csv", 600, "\n"), ("b.csv", 7, ""), ("c.csv", 0, "")):
        body = "\n".join(f'"{i}","{label}","{text}"' for i, label, text in rows[:n]) + end
        (tmp_path / name).write_text(raw.BOM + body if n else "", encoding="utf-8")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # records of many sizes cross splits
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = [tuple(r) for r in raw.read_labelled(spark, str(tmp_path)).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    want = [(i, label, text.replace('""', '"')) for n in (600, 7) for i, label, text in rows[:n]]
    assert sorted(got) == sorted(want)
    one = [tuple(r) for r in raw.read_labelled(spark, str(tmp_path), splittable=False).collect()]
    assert sorted(got) == sorted(one)
