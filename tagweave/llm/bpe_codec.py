"""Operator 10: byte-level BPE encoding and decoding with a segment tree over pair ranks.

A text is cut where no token can span (before a space that a non-space follows), each distinct
piece is pre-split by the tokenizer's pattern and encoded once per task.  Encoding a word keeps
its symbols as a linked list and a segment tree over the ranks of adjacent pairs: the root is
the lowest rank, leftmost among equals, so it names the next merge; a merge changes at most
three leaves, each a logarithmic path update; the word is done when the root holds no rank.
Words of similar length are encoded side by side, one numpy lane each.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame

from tagweave.llm.common import CACHE_ENTRIES, held, map_texts

#: A cut before such a space never falls inside a token: the space joins what follows it.
SAFE_CUT = re.compile(r"(?= \S)")

#: Fixed value: the pre-split pattern of byte-level BPE.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NO_PAIR = np.int64(1) << 40


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies -> byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Byte-level BPE vocabulary: token bytes, merge ranks, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        ids = spec["model"]["vocab"]
        self.token_bytes = {i: bytes(to_byte[c] for c in s) for s, i in ids.items()}
        self.byte_id = np.zeros(256, np.int64)
        for c, b in to_byte.items():
            self.byte_id[b] = ids[c]
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.pair_to: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            key = (ids[a], ids[b])
            self.pair_rank[key] = rank
            self.pair_to[key] = ids[a + b]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        for s, i in self.special.items():
            self.token_bytes[i] = s.encode()
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        self._pairs()

    def _pairs(self):
        """Sorted (left, right) keys for vectorised rank look-ups."""
        self.base = np.int64(max(self.token_bytes) + 2)
        keys = np.array([a * self.base + b for a, b in self.pair_rank], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.fromiter(self.pair_rank.values(), np.int64)[order]
        self.to = np.fromiter(self.pair_to.values(), np.int64)[order]

    def segments(self, text: str) -> list[str]:
        """The text split at special strings; odd places hold the special strings."""
        return self.special_re.split(text) if self.special_re and any(s in text for s in self.special) else [text]


def encode_lanes(vocab: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Ids of each word as little-endian uint32, one lane each; best for words of like length."""
    n = len(words)
    width = 1
    while width < max(map(len, words)):
        width *= 2
    lens = np.fromiter(map(len, words), np.int64, n)
    sym = np.full((n, width + 1), -1, np.int64)
    inside = np.arange(width + 1)[None, :] < lens[:, None]
    sym[inside] = vocab.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    lane = np.arange(n)
    nxt = np.tile(np.arange(1, width + 2, dtype=np.int64), (n, 1))
    prv = np.tile(np.arange(-1, width, dtype=np.int64), (n, 1))
    # Leaf value: rank * width + place, so the minimum is the leftmost lowest rank.
    tree = np.full((n, 2 * width), NO_PAIR, np.int64)

    def leaf(rows, at, right):
        a, b = sym[rows, at], sym[rows, right]
        key = np.where((a >= 0) & (b >= 0), a * vocab.base + b, -1)
        i = np.searchsorted(vocab.keys, key)
        i[i == len(vocab.keys)] = 0
        return np.where(vocab.keys[i] == key, vocab.ranks[i] * width + at, NO_PAIR)

    for at in range(width - 1):
        rows = lane[lens > at + 1]
        if len(rows):
            tree[rows, width + at] = leaf(rows, np.full(len(rows), at), np.full(len(rows), at + 1))
    for node in range(width - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

    def climb(rows, at):
        node = (at + width) >> 1
        for _ in range(width.bit_length() - 1):
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    live = lane[tree[:, 1] < NO_PAIR] if width > 1 else lane[:0]
    while len(live):
        at = tree[live, 1] % width
        right = nxt[live, at]
        key = sym[live, at] * vocab.base + sym[live, right]
        sym[live, at] = vocab.to[np.searchsorted(vocab.keys, key)]
        sym[live, right] = -1
        after = nxt[live, right]
        nxt[live, at] = after
        has_after = after <= width
        prv[live[has_after], after[has_after]] = at[has_after]
        tree[live, width + right] = NO_PAIR
        tree[live, width + at] = leaf(live, at, np.minimum(after, width))
        before = prv[live, at]
        has = before >= 0
        rows = live[has]
        tree[rows, width + before[has]] = leaf(rows, before[has], at[has])
        climb(live, right)
        climb(live, at)
        climb(rows, before[has])
        live = live[tree[live, 1] < NO_PAIR]
    kept = sym >= 0
    raw = sym[kept].astype("<u4").tobytes()
    ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
    return [raw[i:j] for i, j in zip([0, *ends], ends)]


class Encoder:
    """Whole-text encoder with a bounded cache of piece -> little-endian uint32 ids."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        import regex
        self.vocab = Vocabulary(path)
        self.split = regex.compile(SPLIT_PATTERN).findall
        self.entries = entries
        self.cache: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        """Encode the pieces that the cache lacks, lanes grouped by padded length."""
        if len(self.cache) > self.entries:
            self.cache.clear()
        split = {p: ws for p in pieces if not p.lstrip(" ").isalpha() and len(ws := self.split(p)) > 1}
        todo: dict[int, list[bytes]] = {}
        for w in (pieces - split.keys()).union(*split.values()) - self.cache.keys():
            raw = w.encode()
            todo.setdefault((len(raw) - 1).bit_length(), []).append(raw)
        for size, words in todo.items():
            step = max(1, (1 << 18) >> size)  # bounds a group's arrays to about 2^18 symbols
            for i in range(0, len(words), step):
                group = words[i:i + step]
                self.cache.update(zip([w.decode() for w in group], encode_lanes(self.vocab, group)))
        for p, ws in split.items():
            self.cache[p] = b"".join([self.cache[w] for w in ws])

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        cut: list[list[list[str] | int]] = []
        for text in texts:
            parts: list[list[str] | int] = []
            for i, seg in enumerate(self.vocab.segments(text or "")):
                if i % 2:
                    parts.append(self.vocab.special[seg])
                elif seg:
                    parts.append(SAFE_CUT.split(seg))
            cut.append(parts)
        out: list[bytes] = [b""] * len(texts)
        at = 0
        while at < len(texts):  # as many texts at a time as keep the cache within its bound
            end, need = at, set()
            while end < len(texts) and len(need) < self.entries:
                for p in cut[end]:
                    if not isinstance(p, int):
                        need.update(p)
                end += 1
            missing = need - self.cache.keys()
            if missing and len(self.cache) > self.entries:
                missing = need
            if missing:
                self._learn(missing)
            get = self.cache.__getitem__
            for k in range(at, end):
                out[k] = b"".join([p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(get, p))
                                   for p in cut[k]])
            at = end
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        table = self.vocab.token_bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


def encoder(path: str) -> Encoder:
    """The encoder and word cache of this worker process."""
    return held(("bpe", path), lambda: Encoder(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids array<int>``: the tokens of every whole text.

    Null text: empty.  Empty text: no ids.  One row per input row, repeated rows included.
    """
    def rows():
        enc = encoder(path)
        return lambda texts: {"ids": [np.frombuffer(b, "<u4").astype(np.int32) for b in enc.encode_batch(texts)]}
    return map_texts(docs, [id_col], text_col, "ids array<int>", rows)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``text``: the inverse of ``encode``; null ids give the empty text."""
    def rows():
        enc = encoder(path)
        return lambda got: {"text": [enc.decode(np.asarray(ids or [], np.int64)) for ids in got]}
    return map_texts(tokens, [id_col], ids_col, "text string", rows)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text, in one pass."""
    def rows():
        enc = encoder(path)
        names = {i: str(i) for i in enc.vocab.token_bytes}

        def run(texts):
            n, a, b = [], [], []
            for raw in enc.encode_batch(texts):
                ids = np.frombuffer(raw, "<u4").tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                data = b"".join(map(enc.vocab.token_bytes.__getitem__, ids)).decode("utf-8", "replace")
                b.append(hashlib.sha256(data.encode()).hexdigest())
            return {"n_tokens": n, "ids_sha256": a, "decoded_sha256": b}
        return run
    return map_texts(docs, ["doc_id"], "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
