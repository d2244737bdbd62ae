"""Operator 9: near-duplicate groups by HyperMinHash sketches and exact verification.

1. *Sketch* (one pass over the texts).  A document's distinct word shingles fall into buckets
   by their hash; each bucket keeps the leading-zero count and some mantissa bits of its least
   hash.  Empty buckets borrow from a fixed order of other buckets for banding only.
2. *Classes.*  Documents with equal shingle sets are one class (their digest is the key, the
   least id its representative); only representatives go on.
3. *Bands.*  Equal runs of compressed registers put representatives into one bucket.
4. *Links.*  No bucket is expanded into all pairs.  First every member is held against the
   bucket's least member.  Then, in buckets whose members are not yet one component, members of
   different components are compared block by block inside a task, by their registers
   (collision-corrected Jaccard estimate) and, unless that rules a link out, on the full sets;
   only links that join components leave the task.  Every link is confirmed on the full sets.
5. *Components* by least-label propagation with pointer jumping over the confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import CACHE_ENTRIES, held, map_arrow, map_texts
from tagweave.session import cut_lineage

BANDS, BAND_ROWS = 32, 5
BUCKETS = BANDS * BAND_ROWS
MANTISSA_BITS = 10
#: Members of one bucket that are compared in one block.
BLOCK = 1500
#: Standard errors below the threshold at which an estimate rules a link out.
SLACK = 5.0
#: Ids sent to every task at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

#: Byte translation: A-Z lower-cased, all else as it is.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (uint64 in, uint64 out)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash, remembered; ``of`` bounds the memory."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    # bytes.split() without arguments splits at exactly these six characters.
    return (text or "").encode().translate(LOWER).split()


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words: the sequence as one."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = held("hashes", WordHashes).of(words)
    n = min(width, len(h))
    count = len(h) - n + 1
    # Seeding with n keeps a short sequence apart from a shingle.
    total = np.full(count, n, np.uint64)
    for i in range(n):
        total = mix64(total + h[i:i + count] * np.uint64(2 * i + 0x9E3779B97F4A7C15))
    return np.unique(total)


def _borrow_order() -> np.ndarray:
    """For each bucket the fixed order in which it looks for a filled one, itself first."""
    b = np.arange(BUCKETS, dtype=np.uint64)
    order = np.argsort(mix64(b[:, None] * np.uint64(BUCKETS) + b[None, :] + np.uint64(12345)), axis=1)
    own = np.arange(BUCKETS)
    rest = order[order != own[:, None]].reshape(BUCKETS, BUCKETS - 1)
    return np.concatenate([own[:, None], rest], axis=1)


BORROW = _borrow_order()


def registers(shingles: np.ndarray) -> np.ndarray:
    """uint16 register per bucket: leading zeros above mantissa bits of its least hash, plus 1; 0: empty."""
    out = np.zeros(BUCKETS, np.uint16)
    if not len(shingles):
        return out
    # Ascending hashes: the first that names a bucket (by its low bits) is the bucket's least.
    bucket = ((shingles & np.uint64(0xFFFFFFFF)) * np.uint64(BUCKETS)) >> np.uint64(32)
    which, first = np.unique(bucket, return_index=True)
    least = (shingles[first] >> np.uint64(12)).astype(np.float64)  # 52 bits are exact
    mantissa, exponent = np.frexp(np.maximum(least, 1))
    zeros = np.minimum(52 - exponent, 62)
    bits = ((2 * mantissa - 1) * (1 << MANTISSA_BITS)).astype(np.int64)
    out[which.astype(np.int64)] = zeros * (1 << MANTISSA_BITS) + bits + 1
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of the registers, empty buckets filled by borrowing."""
    filled = regs > 0
    if not filled.all():
        empty = np.flatnonzero(~filled)
        source = BORROW[empty, np.argmax(filled[BORROW[empty]], axis=1)]
        regs = regs.copy()
        regs[empty] = regs[source]
    rows = regs.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(BAND_ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def estimate(one: np.ndarray, many: np.ndarray, n_one: int, n_many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimate of a sketch against others, and its standard error at 0.8.

    Registers of different hashes agree by chance about 0.1699 * 2^-bits * 4r / (1 + r)^2 times
    each (r: ratio of set sizes); that expectation is taken off the agreements.
    """
    either = (one > 0) | (many > 0)
    used = np.maximum(either.sum(axis=1), 1)
    agree = ((one == many) & either).sum(axis=1)
    ratio = n_one / np.maximum(n_many, 1)
    chance = 0.169919 * 2.0 ** -MANTISSA_BITS * 4 * ratio / (1 + ratio) ** 2
    got = agree / used
    return np.clip((got - chance) / (1 - chance), 0, 1), np.sqrt(0.16 / used)


def sketch(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id, n_shingles, digest, regs, bands`` of every whole text (null: empty, no bands)."""
    def rows():
        import xxhash

        def run(texts):
            out = {"n_shingles": [], "digest": [], "regs": [], "bands": []}
            for t in texts:
                s = shingle_hashes(t, width)
                r = registers(s)
                out["n_shingles"].append(len(s))
                out["digest"].append(xxhash.xxh128_hexdigest(s.tobytes()) if len(s) else None)
                out["regs"].append(r.tobytes())
                out["bands"].append(band_keys(r) if len(s) else [])
            return out
        return run
    return map_texts(docs, ["doc_id"], "text", "n_shingles long, digest string, regs binary, bands array<long>", rows)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, shingles``: the full set of every text as 64-bit hashes."""
    def rows():
        return lambda texts: {"shingles": [shingle_hashes(t, width).view(np.int64) for t in texts]}
    return map_texts(docs, ["doc_id"], "text", "shingles array<long>", rows)


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links(a, b)``: the least node reachable from it.

    Each turn takes the least label around a node and then the label's own label, so chains
    shrink at least by half; hot nodes are pre-aggregated before they are shuffled.
    """
    both = cut_lineage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")) \
        .select("node", F.least("node", "label").alias("label"))
    labels = cut_lineage(labels)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")) \
            .agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("lower"))
        jump = labels.select(F.col("node").alias("lower"), F.col("label").alias("jumped"))
        new = cut_lineage(step.join(jump, "lower").select(
            "node", "label", F.least("lower", "jumped").alias("next")))
        changed = new.filter(F.col("next") < F.col("label")).limit(1).count()
        labels = new.select("node", F.col("next").alias("label"))
        if not changed:
            return labels


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` with den * |A and B| >= num * |A or B| on the full sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    shared = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"),
                         F.size(F.array_intersect("sa", "sb")).alias("same"))
    return shared.filter(F.col("same") * (den + num) >= F.col("n") * num).select("a", "b")


def _star_candidates(bucket: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``: each bucket's least member with every other member, unless an estimate rules it out."""
    pairs = bucket.filter(F.col("node") != F.col("center")).select(F.col("center").alias("a"), F.col("node").alias("b"))
    one = reps.select(F.col("node").alias("a"), F.col("regs").alias("ra"), F.col("n").alias("na"))
    two = reps.select(F.col("node").alias("b"), F.col("regs").alias("rb"), F.col("n").alias("nb"))
    both = pairs.distinct().join(one, "a").join(two, "b")
    schema = pa.schema([pa.field("a", pa.int64()), pa.field("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ra = np.frombuffer(b"".join(part["ra"].to_pylist()), np.uint16).reshape(-1, BUCKETS)
                rb = np.frombuffer(b"".join(part["rb"].to_pylist()), np.uint16).reshape(-1, BUCKETS)
                got, error = estimate(ra, rb, part["na"].to_numpy(), part["nb"].to_numpy())
                kept = part.filter(pa.array(got >= threshold - SLACK * error))
                yield pa.RecordBatch.from_arrays([kept["a"], kept["b"]], schema=schema)

    return map_arrow(both.select("a", "b", "ra", "rb", "na", "nb"), run, "a long, b long")


class _Block:
    """Members of one bucket (or of two of its blocks) whose pairs are still to be confirmed."""

    def __init__(self, key: int, across: bool, threshold: float, num: int, den: int):
        self.key, self.across, self.threshold, self.num, self.den = key, across, threshold, num, den
        self.node, self.label, self.n, self.block, self.regs, self.bands, self.sets = ([] for _ in range(7))

    def links(self) -> list[tuple[int, int]]:
        """Confirmed links that join different components, a spanning forest of them."""
        if len(set(self.label)) < 2:
            return []
        node, label, n, block = (np.asarray(x) for x in (self.node, self.label, self.n, self.block))
        regs, bands = np.stack(self.regs), np.stack(self.bands)
        parent: dict[int, int] = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for i in range(len(node) - 1):
            later = np.arange(i + 1, len(node))
            later = later[(label[later] != label[i]) & (node[later] != node[i])
                          & ((block[later] != block[i]) if self.across else True)]
            if not len(later):
                continue
            # Two members may share several buckets; the pair belongs to the first of them.
            first = np.argmax(bands[later] == bands[i], axis=1)
            later = later[bands[i][first] == self.key]
            if not len(later):
                continue
            got, error = estimate(regs[i], regs[later], n[i], n[later])
            later = later[got >= self.threshold - SLACK * error]
            for j in later[np.argsort(-got[got >= self.threshold - SLACK * error], kind="stable")].tolist():
                x, y = find(label[i]), find(label[j])
                if x == y:
                    continue
                a, b = self.sets[i], self.sets[j]
                # The sizes alone bound the similarity.
                if self.den * min(len(a), len(b)) < self.num * max(len(a), len(b)):
                    continue
                same = len(np.intersect1d(a, b, assume_unique=True))
                if self.den * same >= self.num * (len(a) + len(b) - same):
                    parent[x] = y
                    out.append((int(node[i]), int(node[j])))
        return out


def _cross_links(bucket: DataFrame, labels: DataFrame, reps: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``(a, b)``: confirmed links between members of one bucket in different components.

    Buckets are cut into blocks by hash and compared block against block, so a task holds two
    blocks at a time; what it emits joins components, at most one row per member and block.
    """
    placed = bucket.select("key", "node").join(labels, "node", "left") \
        .select("key", "node", F.coalesce("label", "node").alias("label"))
    # A bucket's least member was held against all others, so a lone pair is settled.
    mixed = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                      F.count("*").alias("size")).filter("lo <> hi and size > 2")
    mixed = mixed.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    full = sets.select(F.col("doc_id").alias("node"), "shingles")
    members = placed.join(mixed, "key") \
        .withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .join(reps, "node").join(full, "node")
    dealt = members.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                           "node", "label", "n", "block", "regs", "bands", "shingles")
    parts = int(bucket.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        out: list[tuple[int, int]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, lo, hi, node, label, n, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            regs = np.frombuffer(b"".join(batch["regs"].to_pylist()), np.uint16).reshape(-1, BUCKETS)
            bands = batch["bands"].flatten().to_numpy().reshape(-1, BANDS)
            ends = batch["shingles"].offsets.to_numpy()
            values = batch["shingles"].values.to_numpy()
            for i in range(batch.num_rows):
                if (at := (key[i], lo[i], hi[i])) != now:
                    if block is not None:
                        out += block.links()
                    now, block = at, _Block(key[i], lo[i] != hi[i], num / den, num, den)
                for store, value in ((block.node, node[i]), (block.label, label[i]), (block.n, n[i]),
                                     (block.block, part[i]), (block.regs, regs[i]), (block.bands, bands[i]),
                                     (block.sets, values[ends[i]:ends[i + 1]])):
                    store.append(value)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                out = []
        if block is not None and (out := block.links()):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return map_arrow(dealt, run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: groups of documents with similar shingle sets.

    Two documents are linked when den * |A and B| >= num * |A or B| for their sets of distinct
    ``width``-word shingles.  Null, empty or blank texts have the empty set and no links.
    ``doc_id`` must be an integer type; rows that share an id count as one document; rows with
    a null id come back with a null ``component_id``, kept and unlinked.  Empty input: empty.
    """
    threshold = num / den
    made = cut_lineage(sketch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width))
    classes = made.filter("digest is not null and doc_id is not null").groupBy("digest") \
        .agg(F.min("doc_id").alias("node"), F.min_by(F.struct("regs", "bands", "n_shingles"), "doc_id").alias("s"))
    reps = cut_lineage(classes.select("digest", "node", F.col("s.regs").alias("regs"), F.col("s.bands").alias("bands"),
                                      F.col("s.n_shingles").alias("n")))
    banded = reps.select(F.explode("bands").alias("key"), "node")
    centers = banded.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("center")).filter("size > 1")
    bucket = cut_lineage(banded.join(centers.select("key", "center"), "key"))
    regs = reps.select("node", "regs", "n")

    involved = cut_lineage(bucket.select(F.col("node").alias("doc_id")).distinct())
    few = involved.count() <= BROADCAST_IDS
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .join(F.broadcast(involved) if few else involved, "doc_id", "left_semi")
    sets = cut_lineage(shingle_sets(picked, width))

    links = cut_lineage(_verified(_star_candidates(bucket, regs, threshold), sets, num, den))
    labels = components(links)
    more = cut_lineage(_cross_links(bucket, labels, reps.select("node", "n", "regs", "bands"), sets, num, den))
    if more.limit(1).count():
        labels = components(links.unionByName(more))

    of_class = reps.select("digest", "node").join(labels, "node", "left") \
        .select("digest", F.coalesce("label", "node").alias("component"))
    out = made.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents, all columns as they are, without near-duplicates of a document with a lesser id.

    What goes is named by ``near_duplicates``; rows that share an id, or have none, are not
    near-duplicates of each other by that alone and stay.
    """
    found = near_duplicates(docs, width, num, den)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    few = gone.count() <= BROADCAST_IDS
    same = docs["doc_id"].cast("long") == F.col("__gone")
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
