"""Operator 13 against counting by hand."""

import collections
import re

import numpy as np

from tagweave.llm import divergence
from tests.llm.cases import documents, empty, frame

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def by_hand(rows, min_docs, ranks):
    n = collections.defaultdict(collections.Counter)
    with_term = collections.defaultdict(collections.Counter)
    for r in rows:
        lang, source = r["lang"] or "", r["source"] or ""
        terms = TERM.findall((r["text"] or "").translate(LOWER))
        n[lang, source].update(terms)
        with_term[lang].update(set(terms))
    out = set()
    for lang in {k[0] for k in n}:
        kept = [t for t, d in with_term[lang].items() if d >= min_docs]
        groups = sorted(s for k, s in n if k == lang)
        total = {t: sum(n[lang, s][t] for s in groups) for t in kept}
        p = lambda count, whole: 1 + 10 ** 9 * (count + 5) // (whole + 5 * len(kept))
        q = {t: p(total[t], sum(total.values())) for t in kept}
        of = {s: {t: p(n[lang, s][t], sum(n[lang, s][u] for u in kept)) for t in kept} for s in groups}
        for s in groups:
            pairs = [(-sum(abs(of[s][t] - of[o][t]) for t in kept), o) for o in groups if o != s]
            above = [(q[t] - of[s][t], t) for t in kept if n[lang, s][t] > 0 and of[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(above)[:ranks])):
                out |= {(lang, s, part, item, -f, k + 1) for k, (f, item) in enumerate(found)}
    return out


def compare(spark, rows, min_docs, ranks):
    got = [tuple(r) for r in divergence.audit_sources(frame(spark, rows), min_docs, ranks).collect()]
    want = by_hand(rows, min_docs, ranks)
    assert len(got) == len(want) and set(got) == want
    return got


def test_odd_and_real_texts(spark):
    got = compare(spark, documents(spark), 3, 5)
    assert {r[2] for r in got} == {"pair", "term"}
    assert divergence.audit_sources(empty(spark)).count() == 0


def test_a_language_without_kept_terms_has_pairs_of_value_zero(spark):
    got = compare(spark, documents(spark)[:30], 1000, 50)
    assert got and all(r[2] == "pair" and r[4] == 0 for r in got)


def test_many_blocks_give_what_one_gives(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GROUP_BLOCK", 3)
    monkeypatch.setattr(divergence, "TERM_BLOCK", 5)
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)  # group totals meet the counts by a shuffle
    draw = np.random.default_rng(1)
    words = ["".join(chr(97 + c) for c in draw.integers(0, 3, 3)) for _ in range(20)] + ["É", "ß", "日本"]
    rows = [{"doc_id": i, "text": " ".join(draw.choice(words, 12)), "lang": "xy"[i % 2], "source": f"s{draw.integers(0, 8)}",
             "n_chars": 0} for i in range(200)]
    rows.append({"doc_id": 999, "text": "", "lang": "x", "source": "silent", "n_chars": 0})
    compare(spark, rows, 4, 6)


def test_probabilities_are_exact_for_large_counts():
    whole = np.array([9 * 10 ** 15, 3 * 10 ** 12, 1], np.int64)
    x = np.array([9 * 10 ** 15 - 1, 10 ** 12, 1], np.int64)
    assert divergence.scaled(x, whole).tolist() == [10 ** 9 * int(a) // int(b) for a, b in zip(x, whole)]
