"""Operators 2, 4, 5, 6 and 8 against brute force, and held-out accuracy."""

import collections
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tagweave.llm import language_id, license_scan, quality, secret_scan, url_filter
from tests.llm.cases import documents, empty, frame

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


# --- operator 2 -----------------------------------------------------------------------------

RULES = [url_filter.Rule.parse(r) for r in ("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")]
URLS = [None, "", "no scheme", "http://", "http://net", "http://NET/", "http://a.Example.NET/en/x?y=/de/#z", "https://example.net/enx",
        "https://example.com/de/1", "https://example.com?x=/de/", "ftp://x.org/fr/", "http://notexample.com/de/a",
        "://org/fr/x", "a://b://org/fr/", "http://example.net/en/\nx", "http://org/fr"]


def by_hand(url):
    head, sep, rest = (url or "").partition("://")
    host = re.split("[/?#]", rest, maxsplit=1)[0] if sep else ""
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0] if sep else ""
    host = host.translate(LOWER)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else None


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS)], "page_id long, url string, host int")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, RULES).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = by_hand(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (verdict or "allow"), u
    assert url_filter.judge_urls(pages.limit(0), RULES).count() == 0


def test_templates_generalise_merge_and_reject(spark):
    pages, labels = [], []

    def add(url, bad=None):
        pages.append((len(pages), url))
        if bad is not None:
            labels.append((len(pages) - 1, bad))

    for i in range(60):
        add(f"http://h.test/spam/{i}", True)
        add(f"http://h.test/news/{i}", False)
        add(f"http://h.test/blog/{i}", False)
        add(f"http://h.test/user/name{chr(97 + i % 26)}{chr(97 + i // 26)}/x", False)
    add("http://h.test/spam/9999")
    add("http://h.test/news/9999.html")
    add("http://other.test/spam/1")
    got = {r["page_id"]: r for r in url_filter.judge_urls(
        spark.createDataFrame(pages, "page_id long, url string"), [],
        spark.createDataFrame(labels, "page_id long, bad boolean")).collect()}
    at = {u: i for i, u in pages}
    assert len(got) == len(pages)
    assert got[at["http://h.test/spam/9999"]]["verdict"] == "block"
    assert got[at["http://h.test/news/9999.html"]]["verdict"] == "allow"
    assert got[at["http://other.test/spam/1"]]["verdict"] == "allow"
    merged = got[at["http://h.test/news/1"]]["template"]
    assert merged == got[at["http://h.test/blog/2"]]["template"] and "blog" in merged and "spam" not in merged
    assert "*" in got[at["http://h.test/user/nameaa/x"]]["template"]


def test_crowded_and_deep_branches_keep_their_verdict(spark):
    pages, labels = [], []

    def add(url, bad, n):
        for i in range(n):
            pages.append((len(pages), f"{url}/{i}"))
            labels.append((len(pages) - 1, bad))

    add("http://crowd.test/spam", True, 40)
    for a in "abcdef":
        for b in "abcdef":
            add(f"http://crowd.test/part{a}{b}", False, 12)
    add("http://crowd.test/seldom", True, 1)
    add("http://deep.test/a/b/c/d/e/bad/f", True, 40)
    add("http://deep.test/a/b/c/d/e/good/f", False, 40)
    add("http://deep.test/a/b/c/d/fine", False, 40)
    got = {r["page_id"]: r for r in url_filter.judge_urls(
        spark.createDataFrame(pages, "page_id long, url string"), [],
        spark.createDataFrame(labels, "page_id long, bad boolean")).collect()}
    assert len(got) == len(pages)
    bad = dict(labels)
    for i, url in pages:
        assert got[i]["verdict"] == ("block" if bad[i] and "seldom" not in url else "allow"), url


# --- operator 4 -----------------------------------------------------------------------------

def test_license_phrases(spark):
    rows = documents(spark)
    pattern = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = collections.Counter()
    for r in rows:
        words = pattern.findall((r["text"] or "").translate(LOWER))
        hits = [(i, label) for p, label in license_scan.BASE_PHRASES for i in range(len(words))
                if words[i:i + len(p.split())] == p.split()]
        starts = [i for i, _ in hits]
        want[(r["doc_id"], len(words), len(hits), min(starts, default=None), max(starts, default=None),
              ",".join(sorted({x for _, x in hits})))] += 1
    got = license_scan.scan_licenses(frame(spark, rows)).cache()
    assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    for r in got.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def test_license_notices_need_their_key_phrase(spark):
    notice = dict((n[0], n[2]) for n in license_scan.NOTICES)["bsd"]
    damaged = notice.replace("source and binary", "binary")
    one_off = notice.replace("permitted", "allowed")
    rows = [{"doc_id": i, "text": t, "lang": "en", "source": "s", "n_chars": 0}
            for i, t in enumerate([f"x y {notice}. z", damaged, f"{one_off} and more", "plain words"] + ["filler text"] * 30)]
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(frame(spark, rows)).collect()}
    assert (got[0], got[1], got[2], got[3]) == ("bsd", "", "bsd", "")


# --- operator 5 -----------------------------------------------------------------------------

def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_language_edge_cases(spark):
    rows = documents(spark)
    got = language_id.identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {r["doc_id"]: r["text"] for r in rows}
    for r in got:
        assert 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in text[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == (not letters)
    assert language_id.identify(empty(spark)).count() == 0
    unlabelled = frame(spark, rows, False).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in language_id.identify(unlabelled).collect()} == {"und"}
    assert language_id.keep_determined(empty(spark)).count() == 0


def test_mixtures_are_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    by_lang = {r["lang"]: r["t"] for r in docs.groupBy("lang").agg({"text": "max"}).withColumnRenamed("max(text)", "t").collect()}
    half = model.mixture(by_lang["de"][:3000] + "\n" + by_lang["es"][:3000])
    assert set(half[0][:2]) == {"de", "es"} and abs(half[1][0] - 0.5) < 0.25
    alone = model.mixture(by_lang["de"][:3000])
    assert alone[0] == ["de"] and alone[1] == [1.0] and 0 < alone[2] <= 1


def test_copies_do_not_move_the_language_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang")
    hot = docs.filter("text is not null").limit(1).crossJoin(spark.range(500)).select("text", "lang")
    once, often = language_id.train(docs, 20), language_id.train(docs.unionByName(hot), 20)
    assert once.languages == often.languages and (once.log_prob == often.log_prob).all()
    # The bound holds: counts of few texts, whatever the number of rows.
    rows, texts = docs.filter("lang = 'en'"), docs.filter("lang = 'en'").select("text").distinct().count()
    assert texts > 40 and language_id.train(rows, 20).languages == ["en"]


def grams_by_hand(text):
    """(order, letters) of every n-gram of letters and marks; other runs are one space."""
    import unicodedata
    out, last = " ", True
    for c in (text or "").lower():
        keep = unicodedata.category(c)[0] in "LM"
        out += c if keep else "" if last else " "
        last = not keep
    out += " " if out != " " and not last else ""
    if out.strip() == "":
        return collections.Counter()
    # A run of others after the last letter and the end are a space each.
    out = out if last is False else out + " "
    return collections.Counter((n, out[i:i + n]) for n in language_id.ORDERS for i in range(len(out) - n + 1)
                               if n > 1 or out[i] != " ")


@pytest.mark.parametrize("text", ["", "1 2", "a", "Ab c", "  x--y, ", "हिन्दी में", "e\u0301t\u0301e", "word " * 3000, "日本語 x"])
def test_ngrams_like_those_by_hand(text):
    found, counts = language_id.ngram_counts(text)
    assert sorted(counts.tolist()) == sorted(grams_by_hand(text).values())
    assert len(set(found.tolist())) == len(found)


def test_undetermined_documents_go(spark):
    rows = documents(spark)
    kept = {r["doc_id"] for r in language_id.keep_determined(frame(spark, rows)).collect()}
    marked = language_id.predict(frame(spark, rows), language_id.train(frame(spark, rows).filter(
        ~language_id.held_out(F.col("doc_id")))), ["doc_id"]).collect()
    assert kept == {r["doc_id"] for r in marked if r["languages"] and r["languages"][0]["share"] >= 0.5}
    assert all(any(c.isalpha() for c in r["text"] or "") for r in rows if r["doc_id"] in kept)
    unlabelled = frame(spark, [{**r, "lang": None} for r in rows])
    left = language_id.keep_determined(unlabelled)
    assert left.columns == unlabelled.columns
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in rows if any(c.isalpha() for c in r["text"] or "")}


# --- operator 6 -----------------------------------------------------------------------------

def counts_by_hand(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for k in range(i, i + 3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def test_quality_counts_and_verdicts(spark):
    rows = documents(spark)
    got = quality.assess(frame(spark, rows)).cache()
    want = collections.Counter((r["doc_id"], *counts_by_hand(r["text"])) for r in rows)
    assert rows_of(got, "doc_id", *quality.COUNTS, "base_failed") == want
    assert not got.filter("base_failed and kept").count()
    assert quality.assess(empty(spark)).count() == 0
    kept = quality.keep_good(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert rows_of(kept, "doc_id") == rows_of(got.filter("kept"), "doc_id")


def measured_rows(spark, groups):
    """One measured row per document of ``groups``: (lang, source) -> function of 0..n-1 and n."""
    fields = [*quality.MEASURES, *quality.SIZES]
    rows = [(lang, source, i % 50 == 49, *[float(of(i).get(m, 0.0)) for m in fields])
            for (lang, source), (of, n) in groups.items() for i in range(n)]
    return spark.createDataFrame(rows, "lang string, source string, base_failed boolean, "
                                 + ", ".join(f"{m} double" for m in fields))


def test_sketch_quantiles_within_their_error(spark):
    sizes = {"word_chars": 600, "n_lines": 30, "n_words": 120}
    rows = measured_rows(spark, {("a", "b"): (lambda i: {"mean_word": (i + 1) / 100, **sizes}, 2000)})
    f = quality.fences(quality.sketches(rows)).first()
    assert f["mean_word_hi"] == pytest.approx(15 + 5 * 10, rel=0.03)
    assert f["mean_word_lo"] == pytest.approx(5 - 5 * 10, rel=0.03)
    # Nothing but zeros: what a few hits are in a document of the median size.
    assert f["symbol_share_hi"] == pytest.approx(9 / 600, rel=0.02)
    assert f["dup_line_share_hi"] == pytest.approx(3 / 30, rel=0.02)
    assert f["repeat_share_hi"] == pytest.approx(9 / 120, rel=0.02)


def test_every_fence_follows_its_group(spark):
    prose = lambda i: {"mean_word": 5 + i % 10 / 10, "word_chars": 900, "n_lines": 60, "n_words": 900,
                       "repeat_share": i % 100 / 1000, "dup_line_share": i % 100 / 2000}
    code = lambda i: {"mean_word": 8 + i % 10 / 2, "word_chars": 90, "n_lines": 60, "n_words": 900,
                      "symbol_share": i % 20 / 100, "repeat_share": i % 100 / 400, "dup_line_share": i % 100 / 500}
    few = lambda i: {**code(i), "mean_word": 90.0}
    f = {(r["lang"], r["source"]): r for r in quality.fences(quality.sketches(measured_rows(
        spark, {("en", "prose"): (prose, 1000), ("en", "code"): (code, 1000), ("en", "few"): (few, 20)}))).collect()}
    for m in quality.MEASURES:
        assert f["en", "code"][f"{m}_hi"] > 1.5 * f["en", "prose"][f"{m}_hi"], m
    # Too few documents: the sketch of the language, in which they count too.
    assert f["en", "prose"]["mean_word_hi"] < f["en", "few"]["mean_word_hi"]
    assert quality.fences(quality.sketches(measured_rows(spark, {("en", "x"): (prose, 1)}).limit(0))).count() == 0


def test_junk_goes_and_clean_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.assess(docs).join(labels, "doc_id").collect()
    clean = [r for r in got if r["quality"] == 1 and not r["base_failed"]]
    junk = [r for r in got if r["quality"] == 0]
    assert sum(r["kept"] for r in clean) >= 0.97 * len(clean)
    assert sum(r["kept"] for r in junk) <= 0.1 * len(junk)


# --- operator 8 -----------------------------------------------------------------------------

def base_by_hand(text):
    assign = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
                        r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def test_secrets_base_spans(spark):
    rows = documents(spark)
    rows[5]["text"] = "Token='ABCDEFGHIJKL' paſsword=aaaaaaaaaaaaaa pASSwd: x=y_z-0123456789 AKIA0000000000000 é AKIA00000000000000"
    got = secret_scan.scan_digests(frame(spark, rows)).cache()
    want = collections.Counter()
    for r in rows:
        spans = base_by_hand(r["text"] or "")
        kinds = collections.Counter(s[2] for s in spans)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()
        want[(r["doc_id"], kinds["assign"], kinds["access"], kinds["hex"], digest)] += 1
    assert rows_of(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    assert sum(r["n_assign"] for r in got.collect()) > 0
    assert secret_scan.scan_digests(empty(spark)).count() == 0


def test_guess_costs():
    cost = secret_scan.log_guesses
    for weak in ("password123", "qwertyuiop", "2024-01-15", "aaaaaaaaaaaa", "required", "changeme1", "Monday2024"):
        assert cost(weak) < secret_scan.MIN_LOG_GUESSES, weak
    for strong in ("x8Kq!29zLpWv", "Tr0ub4dor&3", "kQ7vZp2LmX"):
        assert cost(strong) >= secret_scan.MIN_LOG_GUESSES, strong
    # The programme finds the cheapest cut: never dearer than brute force or than its parts.
    for a, b in (("password", "x8Kq"), ("qwerty", "2024-01-15"), ("zz", "zz")):
        assert cost(a + b) <= min(len(a + b), cost(a) + cost(b) + secret_scan.SEAM) + 1e-9


def test_short_random_values_and_aligned_columns_are_found():
    for value in ("xK9#mQ2z", "xK9#mQ", "r7Kq2v", "xK9mQ2"):
        for text in (f"password: {value}", f"password          =          {value}"):
            assert [(text[a:b], k) for a, b, k in secret_scan.spans_of(text)] == [(value, "guess")], text
    for weak in ("password123", "qwertyuiop", "2024-01-15", "aaaaaaaaaaaa", "required", "changeme1", "Monday2024", "12345678"):
        assert not secret_scan.is_secret(weak), weak


def test_method_spans_and_redaction(spark):
    text = "the password is x8Kq!29zLpWv. and the secret is required; token = \"04dbebab91ab8568\" end"
    spans = secret_scan.spans_of(text)
    assert [(text[a:b], k) for a, b, k in spans if k == "guess"] == [("x8Kq!29zLpWv", "guess")]
    clean = secret_scan.redact_text(text)
    assert "x8Kq" not in clean and "04db" not in clean and "required" in clean and clean.endswith(" end")
    rows = documents(spark)
    docs = frame(spark, rows)
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns
    got = rows_of(out, "doc_id", "text")
    assert got == collections.Counter((r["doc_id"], None if r["text"] is None else secret_scan.redact_text(r["text"])) for r in rows)


def test_license_notices_equal_scoring_every_alignment():
    """Files that hold all notices, lightly edited: no alignment whose key phrase stands is lost."""
    import math
    import random

    from tagweave.llm import license_scan as LS
    made = LS.templates()
    vocabulary = sorted({w for t in made for w in t.words})
    draw = random.Random(11)
    df = {w: draw.randint(0, 900) for w in vocabulary}
    index = LS.Index(made, 1000, df)
    idf = {w: math.log(1001 / (n + 1)) + 1e-6 for w, n in df.items()}
    lost = 0
    for _ in range(150):
        words = []
        for t in draw.sample(made, len(made)):
            part = list(t.words)
            for _ in range(draw.randint(0, 4)):
                part[draw.randrange(len(part))] = draw.choice([b"changed", b"other", draw.choice(vocabulary)])
            words += part + [b"filler"] * draw.randint(0, 3)
        got = {(t, s) for t, s, _ in index.scan(words)}
        for t, template in enumerate(made):
            mass = sum(idf[w] for w in template.words)
            for s in range(-len(template.words), len(words)):
                a = s + template.key_at
                if a < 0 or words[a:a + len(template.key)] != template.key:
                    continue
                stands = sum(idf[w] for i, w in enumerate(template.words) if 0 <= s + i < len(words) and words[s + i] == w)
                if template.base or stands >= LS.MIN_SCORE * mass:
                    lost += (t, s) not in got
                else:
                    assert (t, s) not in got
    assert lost == 0


def test_planted_values_precision_and_recall(spark):
    """Random values of every kind in credential context against names, addresses, calls and words."""
    import random
    import string

    draw = random.Random(6)
    rows = documents(spark)
    ranks = secret_scan.word_ranks(frame(spark, rows))
    assert secret_scan.word_ranks(empty(spark)) == secret_scan.WORD_RANK
    alphabets = (string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters, string.ascii_letters + string.digits,
                 string.ascii_letters + string.digits + "!@#$%^&*", string.ascii_lowercase + string.digits)
    secrets = ["".join(draw.choices(a, k=draw.randint(10, 24))) for a in alphabets for _ in range(60)]
    secrets += ["kqzvxwjpmhrtbnfd", "XKQZPVNMWTRBHGFD", "xK9#mQ2z", "aB3-xY9-kL2"]
    words = [w for w in ranks if w.isascii() and len(w) > 3]
    plain = ["https://example.com/a/b/c", "https://example.com/path/to/thing", "config.get(env)", "process.env.SECRET", "${API_KEY}",
             "foo.bar.baz()", "some_function_name", "someMethodName", "required", "2024-01-15", "password123"]
    plain += [draw.choice(words) for _ in range(150)] + ["_".join(draw.sample(words, 3)) for _ in range(100)]
    plain += ["https://www." + draw.choice(words) + ".org/" + "/".join(draw.sample(words, 3)) for _ in range(100)]
    found = [v for v in secrets if any(k in ("guess", "assign") for _, _, k in secret_scan.spans_of(f"password is {v} here", ranks))]
    wrong = [v for v in plain if secret_scan.spans_of(f"key: {v} here", ranks)]
    assert len(found) >= 0.98 * len(secrets), sorted(set(secrets) - set(found))[:10]
    assert len(wrong) <= 0.02 * len(plain), wrong[:10]


def test_a_copied_password_does_not_become_a_word(spark):
    docs = spark.createDataFrame([(i, "the password is zqkvwjxhpt and the plain words stand here") for i in range(50)], "doc_id long, text string")
    ranks = secret_scan.word_ranks(docs)
    assert "zqkvwjxhpt" not in ranks and "stand" in ranks
    assert all("zqkvwjxhpt" not in r["text"] for r in secret_scan.redact(docs).collect())
