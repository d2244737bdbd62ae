"""Golden cases of the cleaning chain (FIXTURES.md section 3)."""

import html
import random
import re
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from tagweave.functions import cleaning as C
from tagweave.functions.escapes import decode_entities, repair_escapes

CASES = [
    ("mail a.b@c.org now", "mail email@genericuser.com now"),
    ("hi @abcdefghijklmnopqrstuvw", "hi @genericuserpqrstuvw"),
    ("see www.x.com http://t.co/1,2", "see ww.x.com http://genericurl.com"),
    ("paid 1,000.50 ok", "paid genericnumber ok"),
    ("1 ,000.50", "genericnumber ,genericnumber"),
    ("soooo!!!! ... 8:08am a : b - c", "soo!! .. genericnumber:08am a b c"),
    ("½ ٣٤ caféééé 3rd 2nd", "½ genericnumber caféé 3rd 2nd"),
    ("paaaaaarty", "paarty"),
]

BACKSLASH = [("\\foo", "foo"), ("foo\\", "foo"), ("\\foo\\", "foo"), (":\\", ":\\"), ("\\:)", "\\:)"),
             ("\\", "\\"), ("a\\b", "a\\b"), ("\\\\x", "\\\\x")]


def _run(spark, rows, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, t string")
    return [r[0] for r in df.orderBy("id").select(fn(F.col("t"))).collect()]


def test_clean_chain_without_spacing(spark):
    got = _run(spark, [c[0] for c in CASES], lambda c: C.clean_text(c, spaced=False))
    assert got == [c[1] for c in CASES]


def test_spaced_commas(spark):
    assert _run(spark, ["paid 1,000.50, ok"], C.spaced_commas) == ["paid  1 ,000.50 ,  ok"]


def test_backslash_rule(spark):
    got = _run(spark, [b[0] for b in BACKSLASH], C.strip_backslash)
    assert got == [b[1] for b in BACKSLASH]


def test_strip_quotes(spark):
    assert _run(spark, ["it's \"x\"\ty"], C.strip_quotes) == ["its xy"]


def test_words_of_empty_text(spark):
    df = spark.createDataFrame([("",), ("a b",)], "t string")
    assert [r[0] for r in df.select(C.words(F.col("t"))).collect()] == [[], ["a", "b"]]


def test_python_whitespace_semantics(spark):
    # Python's str.split() treats these as whitespace; so must we
    text = "a b c\x1cd　e"
    assert _run(spark, [text], C.normalise_whitespace) == [" ".join(text.split())]


def _decoded(spark, texts, fn):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", fn(F.col("s")).alias("s"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    return [r["s"] for r in df.orderBy("i").collect()]


def test_decode_entities_small(spark):
    got = _decoded(spark, ["a &amp; b &lt;x&gt; &copy; &#39;q&#39;", "plain && text", "", None, "&", "&amp;lt; &amp"], decode_entities)
    assert got == ["a & b <x> © 'q'", "plain && text", "", None, "&", "&lt; &"]


def test_decode_entities_equals_the_standard_library(spark):
    """All names, with and without a semicolon and followed by letters; numbers of every kind; random mixtures."""
    texts = [f"{a}&{n}{b}" for n in html5 for a, b in (("", ""), ("x", "y"), ("&", " z;"))]
    texts += [f"&{n.rstrip(';')}" for n in html5]
    numbers = [*range(0, 0x300), *range(0xD7F0, 0xD810), *range(0xDFF0, 0xE010), *range(0xFDC0, 0x10010), 0x1F600, 0x1FFFE,
               0x10FFFD, 0x10FFFE, 0x10FFFF, 0x110000, 0xFEFF, 10**8, 10**20]
    texts += [f"a&#{n};b&#x{n:x}c&#X{n:X};&#000{n} " for n in numbers]
    rng = random.Random(3)
    texts += ["".join(rng.choice(["&", "#", "x", "lt", "amp", ";", "38", "é", "😀", "not", "in", " ", "\n", "<", "A"])
                      for _ in range(40)) for _ in range(2000)]
    got = _decoded(spark, texts, decode_entities)
    wrong = [(t, g, html.unescape(t)) for t, g in zip(texts, got) if g != html.unescape(t)]
    assert not wrong, wrong[:5]


def test_repair_escapes_keeps_non_ascii(spark):
    got = _decoded(spark, ["caf\\u00e9 und über \\x41", "nothing", None, "", "\\", "\\\\u0041\\U0001F600\\n\\x4",
                           "\\ud83d\\ude00 \\U00110000 \\ufeff|\\x00|"], repair_escapes)
    assert got == ["café und über A", "nothing", None, "", "\\", "\\A😀\\n\\x4", "\\ud83d\\ude00 \\U00110000 \ufeff|\0|"]


def test_repair_escapes_equals_a_plain_loop(spark):
    pattern = re.compile(r"\\(u[0-9a-fA-F]{4}|U000[0-9a-fA-F]{5}|x[0-9a-fA-F]{2})")
    rng = random.Random(4)
    texts = ["".join(rng.choice(["\\", "u", "U", "x", "0", "00", "41", "e9", "é", "😀", " ", "\n"]) for _ in range(40))
             for _ in range(2000)]
    assert _decoded(spark, texts, repair_escapes) == [pattern.sub(lambda m: chr(int(m[1][1:], 16)), t) for t in texts]
