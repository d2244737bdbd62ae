"""Tagging, pre-processing and CoNLL ingestion."""

from pyspark.sql import functions as F

from tagweave.operators import tagging as T


def test_preprocess_golden(spark):
    df = spark.createDataFrame(
        [(0, [("The", "D"), ("Good", "A"), ("dog", "N"), ("!", ",")]), (1, [("the", "D")])],
        "doc_id long, tokens array<struct<word:string,tag:string>>")
    out = T.preprocess(df, {"A+R": ["A", "R"], "N": ["N"]}, stopwords=["the"])
    got = {r["doc_id"]: [(t["word"], t["grp"]) for t in r["terms"]] for r in out.collect()}
    assert got == {0: [("good", "A+R"), ("dog", "N"), ("!", "DEFAULT")], 1: []}


def test_first_group_wins(spark):
    df = spark.createDataFrame([(0, [("x", "A")])], "doc_id long, tokens array<struct<word:string,tag:string>>")
    out = T.preprocess(df, {"G1": ["A"], "G2": ["A", "N"]}, stopwords=[])
    assert out.first()["terms"][0]["grp"] == "G1"


def test_rule_tags(spark):
    words = ["http://x", "a@b.c", "@bob", "#tag", "genericnumber", "9am", ":-)", ",", "quickly", "running",
             "useful", "dog"]
    df = spark.createDataFrame([(0, words)], "doc_id long, words array<string>")
    tags = [t["tag"] for t in T.tag_words(df).first()["tokens"]]
    assert tags == ["U", "U", "@", "#", "$", "$", "E", ",", "R", "V", "A", "N"]


def test_lexicon_wins_over_rules(spark):
    df = spark.createDataFrame([(0, ["lol", "dog"])], "doc_id long, words array<string>")
    tags = [t["tag"] for t in T.tag_words(df, lexicon={"lol": "!"}).first()["tokens"]]
    assert tags == ["!", "N"]


def test_read_conll(spark, tmp_path):
    from tagweave.sources.conll import read_conll
    p = tmp_path / "tagged.csv"
    p.write_text("good\tA\t0.9\ndog\tN\t0.8\n\nbad\tA\t0.7\n\n", encoding="utf-8")
    got = [[(t["word"], t["tag"]) for t in r["tokens"]] for r in read_conll(spark, str(p)).orderBy("doc_pos").collect()]
    assert got == [[("good", "A"), ("dog", "N")], [("bad", "A")]]


def test_lexicon_wins_whatever_its_form(spark):
    from tagweave.operators import tagging as T
    docs = spark.createDataFrame([(1, ["zork", "runs", "zork"]), (2, []), (3, None), (1, ["zork"])],
                                 "doc_id long, words array<string>")
    table = spark.createDataFrame([("zork", "V"), ("zork", "A"), ("zork", "A"), (None, "N")], "w string, t string")
    rules = {r["word"]: r["tag"] for row in T.tag_words(docs, "words").where("size(words) = 3").collect() for r in row["tokens"]}
    for lexicon, tag in ((table, "A"), ({"zork": "R"}, "R")):
        got = sorted((r["doc_id"], None if r["tokens"] is None else [tuple(t) for t in r["tokens"]])
                     for r in T.tag_words(docs, "words", lexicon=lexicon).where("words is not null").collect())
        assert got == [(1, [("zork", tag)]), (1, [("zork", tag), ("runs", rules["runs"]), ("zork", tag)]), (2, [])]
