"""Operator 1: best-fit packing of tokenised documents into sequences, certified by bounds.

Documents become pieces of at most ``capacity`` tokens.  Pieces are dealt to partitions, each
packed by best-fit decreasing.  Dual feasible functions give a lower bound on each partition's
bins: where it is met the partition is certified and gives up only its emptiest bin; a
partition with a gap gives up every bin that is not full.  What was given up is dealt anew and
packed again, until one partition holds it all or a round saves no bin.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.bpe_codec import byte_alphabet
from tagweave.llm.common import CACHE_ENTRIES, ROW, held, map_arrow, map_texts, schema_of
from tagweave.session import cut_lineage

#: Pieces that one partition packs (narrow rows; a partition's bins stay in memory).
GROUP_ROWS = 20_000

#: Marks that often close a word and are a token run of their own after a letter.
CLOSING = (".", ",", ";", ":", "!", "?")

#: Packs n ids, for n up to twice a word's letters (a Latin-1 letter is two bytes at most).
PACK = [struct.Struct(f"<{n}I").pack for n in range(256)]

PIECE_DDL = "piece int, start long, length long, ids_crc32 long"


class SpacedTokenizer(dict):
    """Ids by a ``tokenizers`` file of a byte-level, lower-casing tokenizer that drops white space.

    No token of such a tokenizer spans a space or line end, so a text's ids are those of its
    space-free pieces in order.  The mapping itself is the cache: piece -> little-endian uint32
    ids, made by the library when a piece is first met; ``room`` bounds it.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        super().__init__()
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.stand_in = {b: c for c, b in byte_alphabet().items()}
        self.entries = entries
        self.closing = {c: self._raw(c) for c in CLOSING}
        self[""] = b""

    def _raw(self, piece: str) -> bytes:
        return np.asarray(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        # A word of Latin-1 letters (one-to-one lower case, nothing to compose) is one pre-split
        # word, so only its merges are left to do; a closing mark after it is a word of its own.
        end = self.closing.get(piece[-1], b"")
        word = piece[:-1] if end else piece
        if word.isalpha() and 2 * len(word) < len(PACK):
            low = word.lower()
            if low.isascii():
                ids = [t.id for t in self.merge(low)]
            elif max(word) <= "\xff":
                ids = [t.id for t in self.merge("".join(map(self.stand_in.__getitem__, low.encode())))]
            else:
                ids = None
            if ids is not None:
                got = self[piece] = PACK[len(ids)](*ids) + end
                return got
        got = self[piece] = self._raw(piece)
        return got

    def room(self) -> None:
        if len(self) > self.entries:
            self.clear()
            self[""] = b""

    def encode(self, text: str) -> bytes:
        """Little-endian uint32 ids of a text."""
        self.room()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def spaced_tokenizer(path: str) -> SpacedTokenizer:
    """The tokenizer and word cache of this worker process."""
    return held(("spaced", path), lambda: SpacedTokenizer(path))


def tokenize_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1,
                    with_ids: bool = False) -> DataFrame:
    """Token pieces of every whole text: ``doc_id, piece, start, length, ids_crc32`` (and ``ids``).

    A document's ids are its tokens and then ``end_id``; only a document longer than
    ``capacity`` is cut, into full pieces and a shorter last one.  Null text: empty, so one
    piece holding ``end_id`` alone.  ``with_ids`` adds the ids (array<int>) of each piece.
    """
    def rows():
        tok = spaced_tokenizer(path)
        end = int(end_id).to_bytes(4, "little")
        step = 4 * capacity

        def run(texts):
            out = {k: [] for k in (ROW, "piece", "start", "length", "ids_crc32", "ids")}
            for i, text in enumerate(texts):
                raw = tok.encode(text or "") + end
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at:at + step]
                    out[ROW].append(i)
                    out["piece"].append(k)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
            return out
        return run
    return map_texts(docs, ["doc_id"], "text", PIECE_DDL + (", ids array<int>" if with_ids else ""), rows)


def dff_bound(lengths: np.ndarray, capacity: int) -> int:
    """Lower bound on the bins of ``capacity`` that hold items of these lengths.

    The best of two families of dual feasible functions: for each threshold t, items above
    capacity - t count as a whole bin and items below t as nothing; for each k, sizes are
    rounded down to multiples of capacity / k after scaling by k + 1.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    below = np.concatenate([[0], np.cumsum(count)])          # items shorter than x
    mass = np.concatenate([[0], np.cumsum(count * size)])    # their total length
    t = np.arange(0, capacity // 2 + 1)
    whole = below[-1] - below[capacity - t + 1]
    middle = mass[capacity - t + 1] - mass[t]
    best = int(np.max(whole + -(-middle // capacity)))
    for k in range(1, 33):
        scaled = (k + 1) * size
        rounded = np.where(scaled % capacity == 0, k * size, scaled // capacity * capacity)
        best = max(best, -(-int((count * rounded).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number and offset of each item, and the fill of each bin.

    Longest first, each into the fullest bin that has room.  Equal lengths are placed
    together: the fullest bin with room keeps being the fullest until it has none left.
    """
    n = len(lengths)
    bin_of, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    fill: list[int] = []
    room: dict[int, list[int]] = {}   # free tokens -> bins
    rooms: list[int] = []             # sorted keys of room

    def open_room(free, b):
        if free:
            if free not in room:
                room[free] = []
                bisect.insort(rooms, free)
            room[free].append(b)

    at = 0
    while at < n:
        size = int(lengths[order[at]])
        end = at
        while end < n and lengths[order[end]] == size:
            end += 1
        while at < end:
            k = bisect.bisect_left(rooms, size)
            if k < len(rooms):
                free = rooms[k]
                b = room[free].pop()
                if not room[free]:
                    del room[free], rooms[k]
            else:
                free, b = capacity, len(fill)
                fill.append(0)
            m = min(free // size, end - at)
            items = order[at:at + m]
            bin_of[items] = b
            offset[items] = fill[b] + size * np.arange(m)
            fill[b] += size * m
            open_room(free - size * m, b)
            at += m
    return bin_of, offset, np.asarray(fill, np.int64)


def _pack_round(pool: DataFrame, groups: int, capacity: int, turn: int, give: bool) -> DataFrame:
    """Best-fit decreasing in each of ``groups`` partitions; ``given`` marks exchanged pieces."""
    keep = [c for c in pool.columns if c not in ("sequence_id", "offset", "given")]
    out = schema_of(pool, keep, "sequence_id long, offset long, given boolean")
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        lengths = table["length"].to_numpy().astype(np.int64)
        bin_of, offset, fill = best_fit_decreasing(lengths, capacity)
        certified = len(fill) == dff_bound(lengths, capacity)
        if not give:
            given = np.zeros(len(fill), bool)
        elif certified:
            given = np.arange(len(fill)) == np.argmin(fill)
        else:
            given = fill < capacity
        base = (np.int64(turn) << 56) + (np.int64(TaskContext.get().partitionId()) << 32)
        cols = [table[c].combine_chunks().cast(arrow.field(c).type) for c in keep]
        cols += [pa.array(base + bin_of), pa.array(offset), pa.array(given[bin_of])]
        yield from pa.Table.from_arrays(cols, schema=arrow).to_batches(max_chunksize=10_000)

    return map_arrow(pool.select(*keep).repartition(groups), run, out)


def pack(pieces: DataFrame, capacity: int = 4096, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity``) plus ``sequence_id`` and ``offset``.

    Every input row is placed, repeated rows included; an empty input gives an empty result.
    Only narrow rows move: leave token ids out and join them back by (doc_id, piece).
    """
    pool = cut_lineage(pieces)
    rows, turn, done, before = pool.count(), 0, None, None
    while True:
        groups = max(1, -(-rows // group_rows))
        packed = cut_lineage(_pack_round(pool, groups, capacity, turn, give=groups > 1))
        given, bins, given_bins = packed.agg(
            F.coalesce(F.sum(F.col("given").cast("long")), F.lit(0)),
            F.count_if(F.col("offset") == 0), F.count_if((F.col("offset") == 0) & F.col("given"))).first()
        if before is not None and bins >= before:
            # Dealing anew saved nothing: the exchanged pieces stay where they were.
            return done.select(packed.drop("given").columns).unionByName(pool.drop("given")) if done is not None \
                else pool.drop("given")
        settled = packed.filter(~F.col("given")).drop("given")
        done = settled if done is None else done.unionByName(settled)
        if not given:
            return done
        pool, rows, before, turn = packed.filter("given"), given, given_bins, turn + 1


def certificate(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row ``sequences, lower_bound``: how far a packing is from the proven minimum.

    The histogram it reads has at most ``capacity`` rows, whatever the input.
    """
    hist = packed.groupBy("length").count().collect()
    lengths = np.repeat([r["length"] for r in hist], [r["count"] for r in hist]).astype(np.int64) if hist \
        else np.zeros(0, np.int64)
    sequences = packed.filter(F.col("offset") == 0).count()
    return packed.sparkSession.createDataFrame([(sequences, dff_bound(lengths, capacity))],
                                               "sequences long, lower_bound long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every document."""
    return pack(tokenize_pieces(docs, path, capacity, end_id), capacity)


def sequences(docs: DataFrame, packed: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids array<int>``, for unique ``doc_id``.

    Token ids are made again and joined to their places, so only this step moves tokens; a
    sequence holds at most ``capacity`` of them.
    """
    ids = tokenize_pieces(docs, path, capacity, end_id, with_ids=True).select("doc_id", "piece", "ids")
    placed = packed.select("doc_id", "piece", "sequence_id", "offset").join(ids, ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
