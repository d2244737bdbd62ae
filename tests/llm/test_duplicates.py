"""Operators 7 and 9 against brute force."""

import collections
import hashlib
import random
import re

import numpy as np

from tagweave.llm import fingerprint, near_dedup
from tagweave.llm.queries import QUERIES
from tests.llm.cases import documents, empty, frame

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def groups_by_hand(rows, width, num=80, den=100):
    sets = collections.defaultdict(list)
    for r in rows:
        sets[r["doc_id"]].append(shingles(r["text"], width))
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if any(x and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_copies(seed=1):
    """Chains and stars of edited texts, some of them just at the threshold."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(4)) for _ in range(3000)]
    rows = []

    def add(words):
        rows.append({"doc_id": 5000 - 3 * len(rows), "text": " ".join(words), "lang": "en", "source": "s", "n_chars": 0})

    for size in (3, 4, 5, 8, 20, 100, 400):
        base = [draw.choice(vocabulary) for _ in range(size)]
        for _ in range(12):
            words = list(base)
            for _ in range(draw.randint(0, max(1, size // 20))):
                words[draw.randrange(size)] = draw.choice(vocabulary)
            add(words)
        chain = list(base)
        for _ in range(12):
            chain = chain[max(1, size // 12):] + [draw.choice(vocabulary) for _ in range(max(1, size // 12))]
            add(chain)
    shared = [draw.choice(vocabulary) for _ in range(60)]
    for _ in range(40):
        add(shared + [draw.choice(vocabulary) for _ in range(draw.choice((10, 20, 40)))])
    return rows


def compare_groups(spark, rows, width):
    got = near_dedup.near_duplicates(frame(spark, rows), width).collect()
    want = groups_by_hand(rows, width)
    assert len(got) == len(rows)
    sizes = collections.Counter((r["doc_id"], len(shingles(r["text"], width))) for r in rows)
    assert collections.Counter((r["doc_id"], r["n_shingles"]) for r in got) == sizes
    wrong = [(r["doc_id"], r["component_id"], want[r["doc_id"]]) for r in got if r["component_id"] != want[r["doc_id"]]]
    assert not wrong
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_odd_and_real_texts(spark):
    compare_groups(spark, documents(spark), 4)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_edited_texts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 30)  # so that buckets are cut into several blocks
    compare_groups(spark, near_copies(), 4)


def test_null_ids_stay_unlinked(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(map(tuple, near_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 3, None, True), (1, 3, 1, True), (2, 3, 1, False)], key=str)


def test_keep_one_keeps_columns_and_least_ids(spark):
    rows = documents(spark)
    docs = frame(spark, rows)
    left = near_dedup.keep_one(docs, 5)
    want = groups_by_hand(rows, 5)
    assert left.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in left.collect()) == \
        collections.Counter(r["doc_id"] for r in rows if want[r["doc_id"]] == r["doc_id"])


def test_estimate_is_close_and_registers_are_hyperminhash():
    draw = np.random.default_rng(4)
    errors = []
    for share in (0.5, 0.8, 0.95):
        for _ in range(30):
            common = draw.integers(0, 2 ** 63, int(2000 * share), dtype=np.uint64)
            rest = draw.integers(0, 2 ** 63, 2 * int(2000 * (1 - share) / 2), dtype=np.uint64)
            a = np.unique(near_dedup.mix64(np.concatenate([common, rest[::2]])))
            b = np.unique(near_dedup.mix64(np.concatenate([common, rest[1::2]])))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            got, error = near_dedup.estimate(near_dedup.registers(a), near_dedup.registers(b)[None, :], len(a), np.array([len(b)]))
            errors.append((got[0] - true) / error[0])
    assert abs(np.mean(errors)) < 0.5 and np.std(errors) < 2
    # A register is one more than (leading zeros, ten mantissa bits) of its bucket's least hash.
    one = np.array([1 << 60], np.uint64)
    regs = near_dedup.registers(one)
    assert (regs > 0).sum() == 1 and regs.max() == (3 << near_dedup.MANTISSA_BITS) + 1


def test_fingerprints_of_edited_texts(spark):
    rows = [r for r in documents(spark) if r["text"] is None or len(r["text"]) < 20_000]
    got = fingerprint.compare_with_next(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    ordered = sorted({r["doc_id"]: r["text"] or "" for r in rows}.items(), reverse=True)
    after = {i: ordered[(k + 1) % len(ordered)][1] for k, (i, _) in enumerate(ordered)}
    repeated = {i for i, n in collections.Counter(r["doc_id"] for r in rows).items() if n > 1}
    text = dict(ordered)
    by_text = collections.defaultdict(set)
    for r in got:
        t = text[r["doc_id"]]
        assert r["n_chars"] == len(t)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text[t].add(r["fingerprint"])
        if r["doc_id"] in repeated:
            continue  # its next row may be its own copy
        k = len(t) // 3
        edited = t[:len(t) - k] + after[r["doc_id"]][:k]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["edited_fingerprint"] == fingerprint.simhash(edited).hex()
    assert all(len(v) == 1 for v in by_text.values())
    long = [r for r in got if r["n_chars"] > 600]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.95
    assert fingerprint.compare_with_next(empty(spark)).count() == 0
    lone = fingerprint.compare_with_next(frame(spark, rows[:1])).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1


def test_search_counts_every_fingerprint_within_the_radius(spark):
    rows = documents(spark, 60)
    words = (rows[2]["text"] or "").split()
    rows += [{"doc_id": 20_000 + 20 * i, "text": " ".join(words[:len(words) - i]), "lang": "en", "source": "s", "n_chars": 0}
             for i in range(4)]
    got = fingerprint.compare_and_search(frame(spark, rows), radius=12, every=20).collect()
    prints = {r["fingerprint"] for r in got}
    assert len(got) == len(rows)
    for r in got:
        near = sum(0 < (int(p, 16) ^ int(r["fingerprint"], 16)).bit_count() <= 12 for p in prints)
        assert r["n_near"] == (near if r["doc_id"] % 20 == 0 else None)
    assert any(r["n_near"] for r in got)


def test_registered_search_finds_one_word_edits_and_counts_copies(spark, tmp_path):
    draw = random.Random(3)
    vocabulary = ["".join(draw.choices("abcdefghijklmnop", k=7)) for _ in range(3000)]
    texts = []
    for _ in range(10):
        words = draw.choices(vocabulary, k=400)
        edited = list(words)
        edited[200] = "changed"
        texts += [" ".join(words)] * 3 + [" ".join(edited)]
    rows = [{"doc_id": 20 * i, "text": t, "lang": "en", "source": "s", "n_chars": len(t)} for i, t in enumerate(texts)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    prints = {20 * i: fingerprint.simhash(t).hex() for i, t in enumerate(texts)}
    first = {p: min(i for i in prints if prints[i] == p) for p in prints.values()}
    size = collections.Counter(prints.values())

    def apart(a, b):
        return (int(a, 16) ^ int(b, 16)).bit_count()

    got = QUERIES["op7_fingerprints"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        own = prints[r["doc_id"]]
        near = {p for p in size if apart(p, own) <= 12}
        assert (r["representative"], r["n_equal"]) == (first[own], size[own] - 1)
        assert (r["n_near"], r["n_near_docs"]) == (len(near) - 1, sum(size[p] for p in near) - 1)
    assert sum(r["n_near"] > 0 for r in got) >= len(got) // 2
    hits = collections.Counter(tuple(r) for r in QUERIES["op7_near_hits"](spark, str(tmp_path)).collect())
    assert hits == collections.Counter((first[a], first[b], apart(a, b), size[b]) for a in size for b in size if apart(a, b) <= 12)


def test_block_tables_find_all_within_the_radius(spark):
    draw = random.Random(9)
    base = [draw.getrandbits(fingerprint.BITS) for _ in range(20)]
    prints = []
    for b in base:
        for flips in range(8):
            x = b
            for bit in draw.sample(range(fingerprint.BITS), flips):
                x ^= 1 << bit
            prints.append(f"{x:0{fingerprint.BITS // 4}x}")
    df = spark.createDataFrame([(p,) for p in prints] + [(None,), (prints[0],)], "fingerprint string")
    got = {tuple(r) for r in fingerprint.near_fingerprints(df, df, 3).collect()}
    want = {(a, b, d) for a in prints for b in prints if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 3}
    assert got == want and any(d > 0 for _, _, d in want)
