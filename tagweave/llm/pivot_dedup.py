"""Operator 11: near-duplicates by 64-bit SimHash, found with pivot distance tables.

1. *Fingerprints* (one pass over the texts): a bit is 1 if it is set in over half of the hashes
   of a text's word shingles.  Equal fingerprints are one class; only classes go on.
2. *Pivot table.*  For every class the Hamming distances to ``PIVOTS`` reference fingerprints are
   computed once.  By the triangle inequality two fingerprints within the radius differ by no
   more than the radius in every coordinate of that table.
3. *Cells.*  A fingerprint is cut into radius + 2 blocks of bits; two fingerprints within the
   radius agree in at least two whole blocks.  A class goes to one cell per pair of blocks
   (10 cells of 25 or 26 bits at radius 3), so every link lies in a cell and unlike fingerprints
   seldom meet.
4. *Search in a cell.*  Members sorted by their first coordinate are searched by range; pairs
   whose largest coordinate difference exceeds the radius are discarded; survivors are verified
   on the fingerprints.  What a cell emits spans its connected sets and is no list of all pairs.
5. *Crowded cells* are cut into blocks of ``BLOCK`` members.  After a first round within blocks
   and components over all, only members outside a cell's largest component are held against
   the other blocks.
6. *Components* by least-label propagation; a component's id is its least document id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import map_arrow, map_texts
from tagweave.llm.near_dedup import components, mix64, words_of
from tagweave.session import cut_lineage

BITS, SEED = 64, 42
PIVOTS = 16
#: Members of a cell that one task searches at a time.
BLOCK = 1 << 14
#: Cells of up to so many members are compared at shifts 1, 2, ... of all cells side by side.
SMALL = 16
#: Crowded cells sent to every task at most; more are joined by a shuffle.
BROADCAST_CELLS = 100_000

#: The reference fingerprints.
REFERENCES = mix64(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def simhash64(text: str | None, width: int = 3) -> int:
    """The fingerprint of a text as an unsigned integer; without words it is 0."""
    import xxhash
    words = words_of(text)
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return h(b" ".join(words), SEED)
    n = len(words) - width + 1
    votes, runs = np.zeros(BITS, np.int64), zip(*(words[i:] for i in range(width)))
    for at in range(0, n, 1 << 15):
        size = min(1 << 15, n - at)
        part = np.fromiter((h(b" ".join(run), SEED) for _, run in zip(range(size), runs)), "<u8", size)
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every whole text as a signed 64-bit number."""
    def rows():
        def signed(x):
            return x - (1 << 64) if x >> 63 else x
        return lambda texts: {"fp": [signed(simhash64(t, width)) for t in texts]}
    return map_texts(docs, ["doc_id"], "text", "fp long", rows)


def pivot_distances(fps: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint (uint64) to every reference."""
    return np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int8)


def cell_masks(radius: int) -> np.ndarray:
    """For every pair of blocks of bits the mask of both; fingerprints within the radius agree in one."""
    edges = [round(i * BITS / (radius + 2)) for i in range(radius + 3)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    return np.array([a | b for a, b in combinations(blocks, 2)], np.uint64)


def pivot_table(classes: DataFrame, radius: int) -> DataFrame:
    """``cell, fp, pivots``: every class in each of its cells, with its row of the pivot table."""
    masks = cell_masks(radius)
    schema = pa.schema([("cell", pa.int64()), ("fp", pa.int64()), ("pivots", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            # Which pair of blocks, and the bits there: mixed into one number, told apart again in the cell.
            cells = mix64((fps[:, None] & masks[None, :]) * np.uint64(2 * len(masks) + 1)
                          + np.arange(len(masks), dtype=np.uint64)).view(np.int64)
            pivots = pa.array([r.tobytes() for r in pivot_distances(fps)], pa.binary())
            times = len(masks)
            at = pa.array(np.repeat(np.arange(len(fps)), times))
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), batch.column(0).take(at), pivots.take(at)],
                                             schema=schema)

    return map_arrow(classes.select("fp"), run, "cell long, fp long, pivots binary")


class Members:
    """Fingerprints with their rows of the pivot table, sorted by the first coordinate."""

    def __init__(self, fps: np.ndarray, pivots: np.ndarray):
        order = np.argsort(pivots[:, 0], kind="stable")
        self.fps, self.pivots = fps[order], pivots[order]
        self.columns = np.ascontiguousarray(self.pivots.T)

    def near(self, fp: np.uint64, pivots: np.ndarray, radius: int, among: np.ndarray) -> np.ndarray:
        """Those of ``among`` (ascending places) within the radius of a fingerprint."""
        lo, hi = np.searchsorted(self.columns[0][among], [pivots[0] - radius, pivots[0] + radius + 1])
        left = among[lo:hi]
        for own, column in zip(pivots[1:], self.columns[1:]):
            if not len(left):
                return left
            left = left[np.abs(column[left] - own) <= radius]
        return left[np.bitwise_count(self.fps[left] ^ fp) <= radius]


def spanning_links(fps: np.ndarray, pivots: np.ndarray, radius: int) -> list[tuple[np.uint64, np.uint64]]:
    """Links that span every connected set of the fingerprints: each is reached once."""
    members = Members(fps, pivots)
    out, left = [], np.arange(len(fps))
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            i = reached.pop()
            found = members.near(members.fps[i], members.pivots[i], radius, left)
            if len(found):
                out += [(members.fps[i], members.fps[j]) for j in found]
                reached += found.tolist()
                left = left[~np.isin(left, found, assume_unique=True)]
    return out


def _links(pairs) -> pa.RecordBatch:
    a, b = (np.array(c, np.uint64).view(np.int64) for c in (zip(*pairs) if len(pairs) else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    fps = batch["fp"].to_numpy().view(np.uint64)
    return fps, np.frombuffer(b"".join(batch["pivots"].to_pylist()), np.int8).reshape(-1, PIVOTS)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end where a run of equal keys ends, with the bounds of the runs in each."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy() for k in keys]
        starts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cut = int(starts[-1]) if len(starts) else 0
        rest = batch.slice(cut)
        if cut:
            yield batch.slice(0, cut), np.concatenate([[0], starts])
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def _within_cells(dealt: DataFrame, radius: int) -> DataFrame:
    """``a, b``: links that span the connected sets within each (cell, block)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in _runs(batches, ["cell", "block"]):
            sizes = np.diff(bounds)
            which = np.repeat(np.arange(len(sizes)), sizes)
            keep = (sizes > 1)[which]
            if not keep.any():
                continue
            few = keep & (sizes <= SMALL)[which]
            fps, pivots = _read(batch.select(["fp", "pivots"]))
            small_fps, small_pivots, small_which = fps[few], pivots[few], which[few]
            for shift in range(1, SMALL):
                i = np.flatnonzero(small_which[shift:] == small_which[:-shift])
                if not len(i):
                    break
                i = i[np.abs(small_pivots[i + shift] - small_pivots[i]).max(axis=1) <= radius]
                i = i[np.bitwise_count(small_fps[i + shift] ^ small_fps[i]) <= radius]
                if len(i):
                    yield _links(np.column_stack([small_fps[i], small_fps[i + shift]]))
            for r in np.flatnonzero(sizes > SMALL):
                part = slice(bounds[r], bounds[r + 1])
                if found := spanning_links(fps[part], pivots[part], radius):
                    yield _links(found)

    by = ["cell", "block"]
    return map_arrow(dealt.repartition(*by).sortWithinPartitions(*by).select("cell", "block", "fp", "pivots"), run,
                     "a long, b long")


def _across_blocks(table: DataFrame, crowded: DataFrame, labels: DataFrame, radius: int) -> DataFrame:
    """``a, b``: links of members outside a crowded cell's largest component with members of others.

    Those members, the seekers, are cut into blocks, all members into blocks likewise, and every
    block of seekers meets every block of members in a task of its own.
    """
    sent = F.broadcast if crowded.count() <= BROADCAST_CELLS else lambda df: df
    members = table.join(sent(crowded.select("cell")), "cell").join(labels.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("label", F.coalesce("label", "fp"))
    members = cut_lineage(members)
    parts = members.groupBy("cell", "label").agg(F.count("*").alias("n"))
    largest = parts.groupBy("cell").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("size"))
    mixed = largest.filter(F.col("size") > F.col("top.n")).select(
        "cell", F.col("top.label").alias("main"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.col("size") - F.col("top.n")) / BLOCK).cast("int").alias("seekers"))
    placed = members.join(sent(mixed), "cell")  # no more rows than crowded cells
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("fp", F.lit(7)), F.col(n)).cast("int")
    columns = ["cell", "row", "column", "seeks", "fp", "label", "pivots"]
    seekers = placed.filter(F.col("label") != F.col("main")).withColumn("row", own("seekers")) \
        .withColumn("column", upto("blocks")).withColumn("seeks", F.lit(True)).select(columns)
    bases = placed.withColumn("column", own("blocks")).withColumn("row", upto("seekers")) \
        .withColumn("seeks", F.lit(False)).select(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in _runs(batches, ["cell", "row", "column"]):
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                part = batch.slice(lo, hi - lo)
                asks = part["seeks"].to_numpy(zero_copy_only=False)
                fps, pivots = _read(part.select(["fp", "pivots"]))
                base, label = Members(fps[~asks], pivots[~asks]), part["label"].to_numpy()
                order = np.argsort(pivots[~asks][:, 0], kind="stable")
                base_label, every = label[~asks][order], np.arange(int((~asks).sum()))
                out = []
                for i in np.flatnonzero(asks):
                    found = base.near(fps[i], pivots[i], radius, every)
                    found = found[base_label[found] != label[i]]
                    # One link into each component is enough.
                    _, first = np.unique(base_label[found], return_index=True)
                    out += [(fps[i], base.fps[j]) for j in found[first]]
                if out:
                    yield _links(out)

    by = ["cell", "row", "column"]
    return map_arrow(seekers.unionByName(bases).repartition(*by).sortWithinPartitions(*by), run, "a long, b long")


def linked_classes(classes: DataFrame, radius: int) -> DataFrame:
    """``node, label``: the component of every fingerprint that lies within the radius of another."""
    table = pivot_table(classes, radius)
    crowded = cut_lineage(table.groupBy("cell").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK)
                          .select("cell", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    n_crowded = crowded.count()
    if n_crowded:
        dealt = table.join(F.broadcast(crowded) if n_crowded <= BROADCAST_CELLS else crowded, "cell", "left") \
            .withColumn("block", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"), F.lit(0)))
    else:
        dealt = table.withColumn("block", F.lit(0))
    links = cut_lineage(_within_cells(dealt, radius))
    labels = components(links)
    if n_crowded:
        more = cut_lineage(_across_blocks(table, crowded, labels, radius))
        if more.limit(1).count():
            labels = components(links.unionByName(more))
    return labels


def pivot_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id``: documents linked by fingerprints that differ in few bits.

    Shingles are ``width`` consecutive words, repeats included (fewer words: the whole
    sequence).  Null, empty and blank texts have fingerprint zero, which links like any other.
    ``component_id`` is the least ``doc_id`` reachable over links of at most ``radius`` bits.
    ``doc_id`` must be an integer type; rows that share an id are linked only by their texts.
    Rows with a null id have a fingerprint, no component and no part in links.  Empty input: empty.
    """
    made = cut_lineage(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width))
    classes = cut_lineage(made.filter("doc_id is not null").groupBy("fp")
                          .agg(F.min("doc_id").alias("least"), F.count("*").alias("size")))
    labels = linked_classes(classes, radius)
    linked = classes.join(labels.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = classes.join(linked.select("fp", "label").join(least, "label").select("fp", "component_id"), "fp", "left")
    # A lone document needs no row here: its component is itself.
    of_class = of_class.filter("size > 1 or component_id is not null") \
        .select("fp", F.coalesce("component_id", "least").alias("component_id"))
    out = made.join(of_class, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))
