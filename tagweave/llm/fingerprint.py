"""Operator 7: SimHash fingerprints, and a search for all within a Hamming radius.

A text's terms are its pairs of adjacent words (a text of one word: that word); each is hashed
to ``BITS`` bits and votes on every bit with its weight, one plus the logarithm of its count.
Single words are no terms: the frequent ones stand in every text of a language.  The sign of
each vote is a bit of the fingerprint.
The share of equal bits of two fingerprints estimates the angle between their term vectors;
likeness is the cosine of that angle, not below 0.

Search: a fingerprint is cut into radius + 1 blocks of bits.  For each block a table holds the
fingerprints permuted so that the block leads; two fingerprints within the radius agree in at
least one block whole, so equality on the leading block finds every such pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tagweave.llm.common import held, map_arrow, map_texts
from tagweave.llm.near_dedup import WordHashes, mix64, words_of
from tagweave.session import cut_lineage

BITS = 256
#: Bits within which the search finds fingerprints: one changed word of a 248-word text (the
#: median) alters 2 of its word pairs, a cosine of 0.992, about 10 of ``BITS`` bits.
SEARCH_RADIUS = 12
#: Fingerprints of one leading block that are compared with a query in one row, about.
PACK = 1 << 14

_LANES = (np.arange(BITS // 64, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def simhash(text: str) -> bytes:
    """Fingerprint of a text; without words all bits are 0."""
    h = held("hashes", WordHashes).of(words_of(text))
    if not len(h):
        return bytes(BITS // 8)
    if len(h) > 1:
        h = mix64(h[:-1] * np.uint64(3) + mix64(h[1:]))
    terms, count = np.unique(h, return_counts=True)
    # Terms in small groups: bits of a group as a 0/1 matrix, votes for 1 as one product.
    weight = np.rint(64 * (1 + np.log(count))).astype(np.float32)
    votes = np.zeros(BITS)
    for at in range(0, len(terms), 4096):
        raw = mix64(terms[at:at + 4096, None] ^ _LANES[None, :]).view(np.uint8)
        votes += weight[at:at + 4096] @ np.unpackbits(raw, axis=1).astype(np.float32)
    return np.packbits(votes * 2 > weight.sum(dtype=np.float64)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated cosine of the term vectors, 0 to 1; equal fingerprints give 1."""
    distance = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return max(0.0, float(np.cos(np.pi * distance / BITS)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (hex) of every whole text; null text: empty, all bits 0."""
    def rows():
        return lambda texts: {"fingerprint": [simhash(t or "").hex() for t in texts]}
    return map_texts(docs, ["doc_id"], "text", "fingerprint string", rows)


def _dealt(docs: DataFrame, ranges: int) -> DataFrame:
    """``range, doc_id, packed``: texts compressed, ids cut into ranges (0 holds the highest)."""
    cast = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = [i / ranges for i in range(1, ranges)]
    found = cast.agg(F.percentile_approx("doc_id", marks, 50 * ranges).alias("c")).first()["c"] if marks else None
    cuts = np.asarray(sorted(set(found or [])), np.int64)
    schema = pa.schema([("range", pa.int32()), ("doc_id", pa.int64()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        pack = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            at = len(cuts) - np.searchsorted(cuts, ids.fill_null(0).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(known, at, len(cuts)).astype(np.int32)), ids,
                 pa.array([pack((t or "").encode()) for t in batch.column(1).to_pylist()], pa.binary())], schema=schema)

    return map_arrow(cast, run, "range int, doc_id long, packed binary")


#: Columns that one document's comparison with the next gives.
PAIR_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")


def _compared(doc_id, text: str, own: bytes, next_text: str, next_own: bytes) -> tuple:
    """A document against its edited text and the next document, as a row of ``PAIR_DDL``."""
    n = len(text)
    k = n // 3
    edited = text[:n - k] + next_text[:k]
    of_edited = own if edited == text else simhash(edited)
    return (doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), own.hex(), of_edited.hex(),
            likeness(own, of_edited), likeness(own, next_own))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint of every whole text, of its edited text, and their likeness; see ``PAIR_DDL``.

    The edited text has its last third (floor of the code points) replaced by as many first
    code points of the next document, by descending ``doc_id``; after the last comes the first.
    Null text: empty.  Equal ids follow each other in the order of their compressed texts; null
    ids come last.  A single document is its own next one; empty input gives an empty result.

    Texts are shuffled once, compressed, by ranges of ids; a task walks its sorted ranges row
    by row.  Only the first and last document of a range meet their neighbours in a join.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(docs, 4 * parts).repartition(parts, "range") \
        .sortWithinPartitions("range", F.col("doc_id").desc_nulls_last(), "packed")
    # place: null for a finished row, else where in its range an unfinished one stands.
    more = ", place string, range int, packed binary"
    schema = to_arrow_schema(T._parse_datatype_string(PAIR_DDL + more))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        unpack = zstandard.ZstdDecompressor().decompress
        rows: list[tuple] = []
        last = None

        def unfinished(place, r):
            rows.append((r[1], None, None, r[3].hex(), None, None, None, place, r[0], r[4]))

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for rng, doc_id, packed in zip(*(part.column(i).to_pylist() for i in range(3))):
                    text = unpack(packed).decode()
                    this = (rng, doc_id, text, simhash(text), packed)
                    if last is not None and last[0] == rng:
                        rows.append(_compared(last[1], last[2], last[3], text, this[3]) + (None, None, None))
                    else:
                        if last is not None:
                            unfinished("tail", last)
                        unfinished("head", this)
                    last = this
                if rows:
                    yield flush()
        if last is not None:
            unfinished("tail", last)
            yield flush()

    walked = cut_lineage(map_arrow(dealt, walk, PAIR_DDL + more))
    names = [f.name for f in T._parse_datatype_string(PAIR_DDL).fields]
    # At most one head and tail per range, and 4 ranges per shuffle partition.
    order = sorted(r["range"] for r in walked.filter("place = 'head'").select("range").collect())
    after = spark.createDataFrame(list(zip(order, order[1:] + order[:1])), "range int, next_range int")
    tails = walked.filter("place = 'tail'").select("doc_id", "range", F.col("packed").alias("own_packed"))
    heads = walked.filter("place = 'head'").select(F.col("range").alias("next_range"), F.col("packed").alias("next_packed"))
    met = tails.join(after, "range").join(heads, "next_range").select("doc_id", "own_packed", "next_packed")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for doc_id, own, other in zip(*(c.to_pylist() for c in batch.columns)):
                text, next_text = unpack(own).decode(), unpack(other).decode()
                rows.append(_compared(doc_id, text, simhash(text), next_text, simhash(next_text)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(zip(*rows), names)],
                                                 names=names)

    return walked.filter("place is null").select(names).unionByName(map_arrow(met, finish, PAIR_DDL))


def classes(prints: DataFrame, every: int) -> DataFrame:
    """``fp, representative, n_docs, asks``: one row per distinct fingerprint, as bytes.

    ``representative`` is the least ``doc_id`` that has it (null if all are null), ``n_docs`` the
    number of rows, ``asks`` whether ``every`` divides an id among them.  Tasks pre-aggregate, so
    a fingerprint of many copies is one row per task.
    """
    return prints.groupBy(F.unhex("fingerprint").alias("fp")).agg(
        F.min("doc_id").alias("representative"), F.count("*").alias("n_docs"),
        F.max(F.coalesce(F.col("doc_id") % every == 0, F.lit(False))).alias("asks"))


def _class_hits(made: DataFrame, radius: int) -> DataFrame:
    """``query, fp, distance, representative, n_docs`` for the classes of ``made`` that ask."""
    hits = _near(made.select("fp"), made.filter("asks").select("fp"), radius, BITS)
    return hits.join(made.select("fp", "representative", "n_docs"), "fp")


def near_hits(docs: DataFrame, radius: int = SEARCH_RADIUS, every: int = 20) -> DataFrame:
    """``query, representative, distance, n_docs``: every class of equal fingerprints within ``radius``
    bits of a class that holds a document whose id ``every`` divides.

    ``query`` and ``representative`` are the least ids of the two classes; each class finds itself
    at distance 0, so a group of exact copies is one row with their number.
    """
    made = cut_lineage(classes(fingerprints(docs).withColumn("doc_id", F.col("doc_id").cast("long")), every))
    asking = made.filter("asks").select(F.col("fp").alias("asked"), F.col("representative").alias("asker"))
    hits = _class_hits(made, radius).withColumnRenamed("query", "asked").join(asking, "asked")
    return hits.select(F.col("asker").alias("query"), "representative", "distance", "n_docs")


def compare_and_search(docs: DataFrame, radius: int = SEARCH_RADIUS, every: int = 20) -> DataFrame:
    """``compare_with_next``, the document's class, and what lies near the documents that ask.

    ``representative`` is the least id and ``n_equal`` the number of the other documents with an
    equal fingerprint.  For documents whose id ``every`` divides, ``n_near`` is the number of
    other distinct fingerprints of the corpus within ``radius`` bits and ``n_near_docs`` that of
    other documents, those with an equal fingerprint included; both are null for all others.
    """
    made = cut_lineage(compare_with_next(docs))  # read twice
    of_class = cut_lineage(classes(made, every))
    found = _class_hits(of_class, radius).groupBy(F.col("query").alias("fp")) \
        .agg(F.sum((F.col("distance") > 0).cast("long")).alias("found"), F.sum("n_docs").alias("found_docs"))
    per_print = of_class.withColumnRenamed("n_docs", "of_class").join(found, "fp", "left")
    # Digests and fingerprints travel as bytes, half as long as their digits.
    hexes = ("edited_sha256", "fingerprint", "edited_fingerprint")
    narrow = made.withColumns({c: F.unhex(c) for c in hexes})
    asked = F.col("doc_id") % every == 0
    met = narrow.join(per_print, F.col("fingerprint") == F.col("fp"), "left")
    return met.withColumns({c: F.lower(F.hex(c)) for c in hexes}).select(
        *made.columns, "representative", (F.col("of_class") - 1).alias("n_equal"),
        F.when(asked, F.col("found")).alias("n_near"), F.when(asked, F.col("found_docs") - 1).alias("n_near_docs"))


#: Hash values of leading blocks that the mark of what is asked for tells apart.
MARKS = 1 << 20


def near_fingerprints(prints: DataFrame, queries: DataFrame, radius: int = 3, bits: int = BITS) -> DataFrame:
    """``query, fingerprint, distance``: all fingerprints within the radius of each query's.

    ``prints`` and ``queries`` have a hex column ``fingerprint``; both are made distinct first,
    so copies meet once.  A query's own fingerprint is part of its result where ``prints`` has it.
    Null fingerprints match nothing.  Exact: the tables miss no pair within the radius.
    """
    def of_hex(df):
        return df.select(F.unhex("fingerprint").alias("fp")).filter(F.col("fp").isNotNull()).distinct()

    hits = _near(of_hex(prints), of_hex(queries), radius, bits)
    return hits.select(F.lower(F.hex("query")).alias("query"), F.lower(F.hex("fp")).alias("fingerprint"), "distance")


def _near(prints: DataFrame, queries: DataFrame, radius: int, bits: int) -> DataFrame:
    """``query, fp, distance`` of distinct fingerprints (bytes) within the radius of distinct queries.

    Fingerprints that share a leading block meet a query as one array (about ``PACK`` at most,
    however many share it) and are compared inside the row; only hits become rows.  Table rows
    whose leading block no query has stay behind: the queries' blocks are marked in a table of
    blocks x ``MARKS`` bits, the same size whatever the corpus, which goes to every task.
    """
    blocks = radius + 1
    digits = bits // 4
    edges = [round(i * digits / blocks) for i in range(blocks + 1)]
    starts = range(0, digits, 16)

    def words(fp: Column) -> Column:
        """The fingerprint as longs of 16 digits, the last of what is left."""
        column = F.hex(fp)

        def number(at, n):
            return F.conv(F.substring(column, at + 1, n), 16, 10).cast("long")
        made = []
        for i, at in enumerate(starts):
            n = min(16, digits - at)
            word = number(at, n) if n <= 8 else F.shiftleft(number(at, n - 8), 32).bitwiseOR(number(at + n - 8, 8))
            made.append(word.alias(f"w{i}"))
        return F.struct(*made)

    def bytes_of(words: Column) -> Column:
        return F.unhex(F.concat(*[F.lpad(F.hex(words[f"w{i}"]), min(16, digits - at), "0") for i, at in enumerate(starts)]))

    def lead(fp: Column, i: int) -> Column:
        return F.substring(F.hex(fp), edges[i] + 1, edges[i + 1] - edges[i])

    def permuted(fp: Column) -> Column:
        """(block number, leading block) of every table."""
        return F.array(*[F.struct(F.lit(i).alias("block"), lead(fp, i).alias("lead")) for i in range(blocks)])

    mark = F.pmod(F.xxhash64("lead"), F.lit(MARKS))
    place, bit = F.floor(mark / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (mark % 64).cast("int"))
    asking = queries.select(F.col("fp").alias("query"), words(F.col("fp")).alias("own"), F.inline(permuted(F.col("fp"))))
    asked = asking.groupBy("block", place.alias("place")).agg(F.bit_or(bit).alias("marks"))
    packs = max(1, -(-prints.count() // PACK))
    # Also a block that all fingerprints share is dealt to packs of bounded size.
    tables = prints.select("fp", F.inline(permuted(F.col("fp")))).withColumn("place", place) \
        .join(F.broadcast(asked), ["block", "place"]).filter(F.col("marks").bitwiseAND(bit) != 0) \
        .select(words(F.col("fp")).alias("words"), "block", "lead", F.pmod(F.xxhash64("fp"), F.lit(packs)).alias("pack")) \
        .groupBy("block", "lead", "pack").agg(F.collect_list("words").alias("prints"))

    def distance(p: Column) -> Column:
        bits_apart = [F.bit_count(F.col(f"own.w{i}").bitwiseXOR(p[f"w{i}"])) for i in range(len(starts))]
        return sum(bits_apart[1:], bits_apart[0]).cast("int")

    met = asking.join(tables, ["block", "lead"]).select("block", "query", F.inline(F.transform(
        F.filter("prints", lambda p: distance(p) <= radius),
        lambda p: F.struct(bytes_of(p).alias("fp"), distance(p).alias("distance")))))
    # A pair that agrees in several blocks is a hit of the first of them alone.
    agreeing = F.coalesce(*[F.when(lead(F.col("query"), i) == lead(F.col("fp"), i), i) for i in range(blocks)])
    return met.filter(F.col("block") == agreeing).select("query", "fp", "distance")
