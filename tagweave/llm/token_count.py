"""Operator 3: token counts by a compiled finite-state tokenizer.

Two deterministic transducers, compiled from the vocabulary file:

* the *splitter* reads character classes and marks where a pre-split word begins.  It has eight
  states, so a block of characters is a map from entry state to exit state; the maps of all
  blocks compose by a parallel prefix scan, after which every block knows its entry state.
* the *merger* reads the bytes of a word.  A state stands for the token starts that can still
  matter at this point: for each, the place in the token trie and the last token before it.
  Its transition on a byte carries the change in the number of tokens of the prefix read, so a
  word's count is the sum over its path.  Transitions are compiled when first met.

Both run once per distinct piece of text and task; pieces are cut where no token can span.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.bpe_codec import SAFE_CUT, Vocabulary
from tagweave.llm.common import CACHE_ENTRIES, held, map_texts

# Splitter states: in letters, digits, other marks; a space that waits for what follows; white
# space; between words; one or two letters of a contraction to come.
LETTERS, DIGITS, MARKS, SPACE, BLANKS, NEW, ONE_MORE, TWO_MORE = range(8)
# Splitter symbols: letter, digit, mark; space or other blank, before a non-blank or not;
# apostrophe that opens a one- or two-letter contraction; end of a piece.
S_LETTER, S_DIGIT, S_MARK, S_SPACE_X, S_SPACE_B, S_BLANK_X, S_BLANK_B, S_APOS1, S_APOS2, S_END = range(10)

#: Characters of a block of the splitter's scan.
BLOCK = 64
#: Compiled merger states a process keeps before it starts anew (bounds memory only).
MERGER_STATES = 300_000


def _splitter_table() -> tuple[np.ndarray, np.ndarray]:
    """(next state, word begins here) for each state and symbol."""
    to = np.zeros((8, 10), np.uint8)
    begin = np.ones((8, 10), bool)
    for state in range(8):
        for symbol, run in ((S_LETTER, LETTERS), (S_DIGIT, DIGITS), (S_MARK, MARKS)):
            to[state, symbol] = run
            begin[state, symbol] = state not in (run, SPACE)
        for symbol, left in ((S_APOS1, ONE_MORE), (S_APOS2, TWO_MORE)):
            glued = state in (MARKS, SPACE)
            to[state, symbol] = MARKS if glued else left
            begin[state, symbol] = not glued
        to[state, S_SPACE_X] = SPACE
        to[state, S_BLANK_X] = NEW
        for symbol in (S_SPACE_B, S_BLANK_B):
            to[state, symbol] = BLANKS
            begin[state, symbol] = state != BLANKS
        to[state, S_END] = NEW
        begin[state, S_END] = False
    for state, after in ((TWO_MORE, ONE_MORE), (ONE_MORE, NEW)):
        to[state, S_LETTER] = after
        begin[state, S_LETTER] = False
    return to, begin


TO, BEGIN = _splitter_table()


@functools.lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point: 0 letter, 1 digit, 2 other, 3 blank."""
    out = np.full(0x110000, 2, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = 0
        elif kind == "N":
            out[c] = 1
    # The code points with the White_Space property.
    for a, b in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
                 (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[a:b + 1] = 3
    return out


def splitter_symbols(code: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Symbol of each character; ``end`` marks the piece ends (their characters are ignored)."""
    kind = character_classes()[code]
    kind[end] = 4
    after = np.append(kind[1:], 4).astype(np.uint8)
    text_after = after < 3
    space = code == 0x20
    symbol = kind.copy()  # letter, digit and mark have their own number
    blank = kind == 3
    symbol[blank] = np.where(space[blank], np.where(text_after[blank], S_SPACE_X, S_SPACE_B),
                             np.where(text_after[blank], S_BLANK_X, S_BLANK_B))
    symbol[end] = S_END
    apostrophe = np.flatnonzero((code == 0x27) & ~end)
    if len(apostrophe):
        padded = np.append(np.where(end, 0, code), [0, 0])
        one, two = padded[apostrophe + 1], padded[apostrophe + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e"))
                | (one == ord("l")) & (two == ord("l")))
        symbol[apostrophe[short]] = S_APOS1
        symbol[apostrophe[long]] = S_APOS2
    return symbol


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (rows): row i maps through blocks 0 to i."""
    out = maps.copy()
    step = 1
    while step < len(out):
        # (first the earlier blocks, then the later ones)
        out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.int64), axis=1)
        step *= 2
    return out


def word_starts(symbols: np.ndarray) -> np.ndarray:
    """Where words begin, by block maps, a prefix scan, and a second pass with known entries."""
    n = len(symbols)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, S_END, np.uint8)
    grid[:n] = symbols
    grid = grid.reshape(blocks, BLOCK)
    maps = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for j in range(BLOCK):
        maps = TO[maps, grid[:, j:j + 1]]
    entry = np.empty(blocks, np.uint8)
    entry[0] = NEW
    entry[1:] = scan_maps(maps)[:-1, NEW]
    begin = np.empty((blocks, BLOCK), bool)
    for j in range(BLOCK):
        begin[:, j] = BEGIN[entry, grid[:, j]]
        entry = TO[entry, grid[:, j]]
    return begin.reshape(-1)[:n]


class Merger:
    """Transducer over the bytes of a word; emits the change in token count per byte.

    Rests on two facts about BPE with one merge per token: a token sequence is the encoding of
    its text exactly when every adjacent pair is the encoding of its own text, and so the
    encoding of a prefix plus one token is an encoding exactly when the last pair is.
    """

    START = -1

    def __init__(self, vocab: Vocabulary, states: int = MERGER_STATES):
        self.rank_of = {vocab.pair_to[p]: r for p, r in vocab.pair_rank.items()}
        self.parts = {vocab.pair_to[p]: p for p in vocab.pair_rank}
        self.pair_rank = vocab.pair_rank
        special = set(vocab.special.values())
        # Trie of token byte strings: child[node * 256 + byte] -> node; token at a node.
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for token, raw in vocab.token_bytes.items():
            if token in special:
                continue
            node = 0
            for b in raw:
                key = node * 256 + b
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = token
        self.pair_ok: dict[tuple[int, int], bool] = {}
        self.limit = states
        self._reset()

    def _reset(self):
        first = ((0, self.START, 0),)
        self.numbers = {first: 0}
        self.states = [first]
        self.step: list[dict[int, tuple[int, int]]] = [{}]

    def is_pair(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side are the encoding of their joined text.

        Undo merges from the latest: as long as no merge across the seam has a lower rank than
        the merge that is undone there, the seam survives.
        """
        key = (left, right)
        known = self.pair_ok.get(key)
        if known is not None:
            return known
        rank = self.rank_of
        never = len(rank) + 1
        bound = never
        while True:
            across = self.pair_rank.get((left, right), never)
            if across < bound:
                ok = False
                break
            rank_l, rank_r = rank.get(left, -1), rank.get(right, -1)
            if rank_l < 0 and rank_r < 0:
                ok = True
                break
            if rank_l > rank_r:
                # The left token is made last; a merge of the same rank further left goes first.
                bound, left = rank_l, self.parts[left][1]
            else:
                # Equal ranks are done from the left, so a merge at the seam would precede this one.
                bound, right = rank_r + 1, self.parts[right][0]
        if len(self.pair_ok) > 2_000_000:
            self.pair_ok.clear()
        self.pair_ok[key] = ok
        return ok

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state on a byte: (next state, change in token count)."""
        kept, change, last = [], None, None
        for node, before, count in self.states[state]:
            nxt = self.child.get(node * 256 + byte)
            if nxt is None:
                continue
            kept.append((nxt, before, count))
            token = self.token_at[nxt]
            if token >= 0 and last is None and (self.is_whole(token) if before == self.START
                                                else self.is_pair(before, token)):
                change, last = count + 1, token
        entries = tuple([(0, last, 0)] + [(n, b, c - change) for n, b, c in kept])
        number = self.numbers.get(entries)
        if number is None:
            number = self.numbers[entries] = len(self.states)
            self.states.append(entries)
            self.step.append({})
        self.step[state][byte] = (number, change)
        return number, change

    def is_whole(self, token: int) -> bool:
        """Whether the token is the encoding of its own text."""
        parts = self.parts.get(token)
        if parts is None:
            return True
        key = (self.START, token)
        known = self.pair_ok.get(key)
        if known is None:
            left, right = parts
            # Its parts, side by side, must survive until the token's own merge joins them.
            known = self.is_whole(left) and self.is_whole(right) and self._seam(left, right, self.rank_of[token])
            self.pair_ok[key] = known
        return known

    def _seam(self, left: int, right: int, final: int) -> bool:
        """As ``is_pair``, but the merge of rank ``final`` across the seam comes last of all."""
        rank = self.rank_of
        if max(rank.get(left, -1), rank.get(right, -1)) >= final:
            return False
        bound, first = len(rank) + 1, True
        while True:
            across = self.pair_rank.get((left, right), len(rank) + 1)
            if across < bound and not first:
                return False
            first = False
            rank_l, rank_r = rank.get(left, -1), rank.get(right, -1)
            if rank_l < 0 and rank_r < 0:
                return True
            if rank_l > rank_r:
                bound, left = rank_l, self.parts[left][1]
            else:
                bound, right = rank_r + 1, self.parts[right][0]

    def count(self, word: bytes) -> int:
        if len(self.states) > self.limit:
            self._reset()
        state, total, step = 0, 0, self.step
        for b in word:
            got = step[state].get(b)
            if got is None:
                got = self.compile(state, b)
            state = got[0]
            total += got[1]
        return total


class Counter:
    """Whole-text token counts with a bounded cache of piece -> count."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.vocab = Vocabulary(path)
        self.merger = Merger(self.vocab)
        self.entries = entries
        self.cache: dict[str, int] = {}
        self.words: dict[bytes, int] = {}

    def _learn(self, pieces: list[str]) -> None:
        """Count new pieces: all of them as one stream through splitter and merger."""
        for at in range(0, len(pieces), 20_000):
            group = pieces[at:at + 20_000]
            stream = "\n".join(group) + "\n"
            code = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
            ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1) - 1
            end = np.zeros(len(code), bool)
            end[ends] = True
            begins = np.flatnonzero(word_starts(splitter_symbols(code, end)))
            piece_of = np.searchsorted(ends, begins)
            # A word runs to the next word or to the end of its piece.
            stops = np.minimum(np.append(begins[1:], len(code)), ends[piece_of])
            totals = [0] * len(group)
            count, words = self.merger.count, self.words
            for p, a, b in zip(piece_of.tolist(), begins.tolist(), stops.tolist()):
                raw = stream[a:b].encode()
                if len(raw) > 12:
                    totals[p] += count(raw)
                    continue
                n = words.get(raw)
                if n is None:
                    n = words[raw] = count(raw)
                totals[p] += n
            self.cache.update(zip(group, totals))

    def count_batch(self, texts: list[str | None]) -> list[int]:
        out = []
        cache = self.cache
        cut = []
        for text in texts:
            segments = self.vocab.segments(text or "")
            pieces = [p for seg in segments[::2] if seg for p in SAFE_CUT.split(seg)] if len(segments) > 1 \
                else SAFE_CUT.split(segments[0]) if segments[0] else []
            cut.append((pieces, len(segments) // 2))
        at = 0
        while at < len(cut):  # as many texts at a time as keep the cache within its bound
            end, need = at, set()
            while end < len(cut) and len(need) < self.entries:
                need.update(cut[end][0])
                end += 1
            if len(cache) > self.entries:
                cache.clear()
                self.words.clear()
            missing = need - cache.keys()
            if missing:
                self._learn(list(missing))
            out += [sum(map(cache.__getitem__, pieces)) + special for pieces, special in cut[at:end]]
            at = end
        return out


def counter(path: str) -> Counter:
    """The compiled tokenizer and cache of this worker process."""
    return held(("count", path), lambda: Counter(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    Null text: empty, so 0 bytes and 0 tokens.  Special strings inside texts count as one
    token.  One row per input row, repeated rows included.
    """
    def rows():
        c = counter(path)
        return lambda texts: {"n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": c.count_batch(texts)}
    counted = map_texts(docs, ["doc_id"], "text", "n_bytes long, n_tokens long", rows)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
