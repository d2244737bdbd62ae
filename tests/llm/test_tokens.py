"""Operators 1, 3 and 10 against the tokenizers library and by exact round trips."""

import collections
import functools
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tagweave.llm import bpe_codec, packing, token_count
from tagweave.llm.queries import tokenizer_path
from tests.llm.cases import documents, empty, frame

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(WORDS)


def test_codec_equals_library(spark, byte_bpe):
    rows = documents(spark)
    got = collections.Counter(tuple(r) for r in bpe_codec.round_trip_digests(frame(spark, rows), BYTES).collect())
    want = collections.Counter()
    for r in rows:
        ids = byte_bpe.encode(r["text"] or "", add_special_tokens=False).ids
        text = byte_bpe.decode(ids, skip_special_tokens=False)
        want[(r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
              hashlib.sha256(text.encode()).hexdigest())] += 1
    assert got == want
    assert bpe_codec.round_trip_digests(empty(spark), BYTES).count() == 0


def test_encode_then_decode_gives_the_text(spark):
    rows = documents(spark, 20)
    back = bpe_codec.decode(bpe_codec.encode(frame(spark, rows), BYTES), BYTES).collect()
    assert collections.Counter(tuple(r) for r in back) == collections.Counter((r["doc_id"], r["text"] or "") for r in rows)


def test_segment_tree_root_is_leftmost_lowest_rank():
    """Lanes of mixed lengths against merging by the definition."""
    vocab = bpe_codec.Vocabulary(BYTES)

    def plain(word):
        ids = [int(vocab.byte_id[b]) for b in word]
        while True:
            ranks = [vocab.pair_rank.get(p, 1 << 30) for p in zip(ids, ids[1:])]
            if not ranks or min(ranks) == 1 << 30:
                return ids
            i = ranks.index(min(ranks))
            ids[i:i + 2] = [vocab.pair_to[ids[i], ids[i + 1]]]

    draw = random.Random(5)
    words = [bytes(draw.choice(b"aeinrst h") for _ in range(draw.randint(1, 40))) for _ in range(300)]
    words += [b"a" * n for n in range(1, 20)]
    assert [np.frombuffer(b, "<u4").tolist() for b in bpe_codec.encode_lanes(vocab, words)] == [plain(w) for w in words]


def test_small_caches_do_not_change_results(byte_bpe, word_bpe):
    texts = [r["text"] for r in documents(None, 60)]
    small = bpe_codec.Encoder(BYTES, entries=50)
    assert [np.frombuffer(b, "<u4").tolist() for b in small.encode_batch(texts)] == \
        [byte_bpe.encode(t or "", add_special_tokens=False).ids for t in texts]
    counter = token_count.Counter(BYTES, entries=50)
    counter.merger.limit = 100
    assert counter.count_batch(texts) == [len(byte_bpe.encode(t or "", add_special_tokens=False).ids) for t in texts]
    spaced = packing.SpacedTokenizer(WORDS, entries=50)
    assert [np.frombuffer(spaced.encode(t or ""), "<u4").tolist() for t in texts] == \
        [word_bpe.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_counts_equal_library(spark, byte_bpe):
    rows = documents(spark)
    got = collections.Counter(tuple(r) for r in token_count.count_tokens(frame(spark, rows), BYTES, 50).collect())
    want = collections.Counter()
    for r in rows:
        n = len(byte_bpe.encode(r["text"] or "", add_special_tokens=False).ids)
        want[(r["doc_id"], len((r["text"] or "").encode()), n, n > 50)] += 1
    assert got == want
    assert token_count.count_tokens(empty(spark), BYTES).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "7", "²", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "!", "日", "́", "\u00a0"]),
                max_size=14).map("".join))
def test_transducers_on_arbitrary_texts(text):
    tokenizer, counter, encoder = by_library_and_operators()
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert counter.count_batch([text]) == [len(want)]
    assert np.frombuffer(encoder.encode_batch([text])[0], "<u4").tolist() == want


@functools.lru_cache(maxsize=1)
def by_library_and_operators():
    return Tokenizer.from_file(BYTES), token_count.Counter(BYTES), bpe_codec.Encoder(BYTES)


def test_block_maps_compose_to_a_sequential_run():
    draw = np.random.default_rng(3)
    symbols = draw.integers(0, 10, 1000).astype(np.uint8)
    state, want = token_count.NEW, []
    for s in symbols:
        want.append(token_count.BEGIN[state, s])
        state = token_count.TO[state, s]
    assert token_count.word_starts(symbols).tolist() == want


def check_packing(rows, packed, word_bpe, capacity=4096):
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in packed:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    want = collections.Counter()
    for r in rows:
        ids = np.asarray(word_bpe.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            want[(r["doc_id"], k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    return len(sequences)


def test_packing_places_every_token_once(spark, word_bpe):
    rows = documents(spark)
    packed = packing.pack_documents(frame(spark, rows), WORDS, 4096, 1).collect()
    n = check_packing(rows, packed, word_bpe)
    assert n == packing.dff_bound(np.array([r["length"] for r in packed]), 4096)
    assert packing.pack_documents(empty(spark), WORDS).count() == 0


def test_exchange_between_partitions_saves_sequences(spark):
    lengths = [int(x) for x in np.random.default_rng(1).integers(1, 100, 400)]
    pieces = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    packed = packing.pack(pieces, capacity=100, group_rows=20)
    made = packing.certificate(packed, 100).first()
    assert packed.count() == len(lengths) and sorted(r["length"] for r in packed.collect()) == sorted(lengths)
    alone = sum(len(packing.best_fit_decreasing(np.array(lengths[i:i + 20]), 100)[2]) for i in range(0, 400, 20))
    assert made["lower_bound"] <= made["sequences"] < alone


def test_bound_never_exceeds_an_optimal_packing():
    """Items cut from full bins: the optimum is the number of bins."""
    draw = random.Random(2)
    for _ in range(200):
        bins, items = draw.randint(1, 6), []
        for _ in range(bins):
            left = 60
            while left:
                x = draw.randint(1, left)
                items.append(x)
                left -= x
        assert packing.dff_bound(np.array(items), 60) == bins
        assert len(packing.best_fit_decreasing(np.array(items), 60)[2]) >= bins
    # Three items above half a bin need three bins though two would hold their sum.
    assert packing.dff_bound(np.array([51, 51, 51]), 100) == 3


def test_sequences_hold_the_tokens(spark, word_bpe):
    rows = documents(spark, 30)[:40]
    docs = frame(spark, rows)
    packed = packing.pack_documents(docs, WORDS)
    total = sum(len(word_bpe.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(len(r["ids"]) for r in packing.sequences(docs, packed, WORDS).collect()) == total
