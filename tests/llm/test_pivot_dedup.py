"""Operator 11 against brute force."""

import collections
import random
import re

import numpy as np
import xxhash

from tagweave.llm import pivot_dedup
from tests.llm.cases import documents, empty, frame
from tests.llm.test_duplicates import near_copies

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint_by_hand(text):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [words[i:i + 3] for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(ids_and_prints, radius=3):
    """Least id reachable, by comparing all pairs."""
    least = {}
    for i, fp in ids_and_prints:
        least[fp] = min(least.get(fp, i), i)
    prints = sorted(least)
    parent = {fp: fp for fp in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(prints):
        for b in prints[k + 1:]:
            if (a ^ b).bit_count() <= radius:
                parent[find(b)] = find(a)
    of = collections.defaultdict(list)
    for fp in prints:
        of[find(fp)].append(least[fp])
    return {fp: min(of[find(fp)]) for fp in prints}


def compare(spark, rows):
    got = pivot_dedup.pivot_duplicates(frame(spark, rows)).collect()
    prints = [fingerprint_by_hand(r["text"]) for r in rows]
    of = components_by_hand([(r["doc_id"], fp) for r, fp in zip(rows, prints)])
    want = collections.Counter((r["doc_id"], f"{fp:016x}", of[fp]) for r, fp in zip(rows, prints))
    assert collections.Counter(map(tuple, got)) == want
    return got


def test_odd_and_real_texts(spark):
    compare(spark, documents(spark))
    assert pivot_dedup.pivot_duplicates(empty(spark)).count() == 0


def test_edited_texts_link(spark):
    got = compare(spark, near_copies(5))
    assert max(collections.Counter(r["component_id"] for r in got).values()) > 1


def test_null_ids_have_a_fingerprint_only(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (4, "A  B c D"), (None, None)], "doc_id long, text string")
    fp = f"{fingerprint_by_hand('a b c d'):016x}"
    got = sorted(map(tuple, pivot_dedup.pivot_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, fp, None), (7, fp, 4), (4, fp, 4), (None, "0" * 16, None)], key=str)


def ball(draw, center, radius, size):
    """Distinct fingerprints within so many bits of a center."""
    out = set()
    while len(out) < size:
        x = center
        for b in draw.sample(range(64), draw.randint(0, radius)):
            x ^= 1 << b
        out.add(x)
    return out


def linked(spark, prints):
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    return {r["node"] & (2 ** 64 - 1): r["label"] & (2 ** 64 - 1) for r in pivot_dedup.linked_classes(df, 3).collect()}


def same_components(got, prints):
    want = components_by_hand([(x, x) for x in prints])
    sizes = collections.Counter(want.values())
    of = collections.defaultdict(set)
    for x in prints:
        if sizes[want[x]] > 1:
            of[want[x]].add(got[x])
        else:
            assert x not in got
    assert all(len(v) == 1 for v in of.values())
    assert len({next(iter(v)) for v in of.values()}) == len(of)


def test_crowded_cells_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(pivot_dedup, "BLOCK", 20)  # cells of more members are cut and searched across blocks
    draw = random.Random(3)
    prints = set()
    for size, radius in ((300, 2), (80, 6), (60, 9), (40, 1)):
        prints |= ball(draw, draw.getrandbits(64), radius, size)
    # A cell full of strangers: the first 26 bits agree, the others are drawn.
    lead = draw.getrandbits(26)
    prints |= {lead | draw.getrandbits(38) << 26 for _ in range(150)}
    prints |= {draw.getrandbits(64) for _ in range(100)}
    same_components(linked(spark, sorted(prints)), sorted(prints))


def test_spanning_links_of_one_cell():
    draw = random.Random(8)
    prints = sorted(ball(draw, draw.getrandbits(64), 5, 200) | {draw.getrandbits(64) for _ in range(50)})
    fps = np.array(prints, np.uint64)
    found = pivot_dedup.spanning_links(fps, pivot_dedup.pivot_distances(fps), 3)
    assert all((int(a) ^ int(b)).bit_count() <= 3 for a, b in found)
    want = components_by_hand([(x, x) for x in prints])
    assert len(found) == len(prints) - len(set(want.values()))  # a forest that spans every component


def test_a_coordinate_difference_above_the_radius_excludes_a_link():
    draw = random.Random(1)
    fps = np.array([draw.getrandbits(64) for _ in range(200)], np.uint64)
    flipped = fps ^ np.array([sum(1 << b for b in draw.sample(range(64), 3)) for _ in fps], np.uint64)
    apart = np.abs(pivot_dedup.pivot_distances(fps) - pivot_dedup.pivot_distances(flipped)).max(axis=1)
    assert apart.max() <= 3
    # Every link shares a cell: at least two of five blocks agree.
    masks = pivot_dedup.cell_masks(3)
    assert len(masks) == 10 and (((fps[:, None] ^ flipped[:, None]) & masks) == 0).any(axis=1).all()


def test_long_texts_are_summed_in_parts():
    text = " ".join(str(i % 977) for i in range(70_000))
    assert pivot_dedup.simhash64(text) == fingerprint_by_hand(text)
