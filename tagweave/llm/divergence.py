"""Operator 13: how far the sources of a language lie apart in their use of words.

The comparison of all groups (language, source) with each other over all kept terms is a cube
with the axes group, group and term.  It is cut into cells (group block, group block, term
block); one task owns a cell.

1. *Counts* (one pass over the texts).  Tasks pre-aggregate occurrences and documents of every
   term per group; one shuffle by language and term sums them and drops rare terms.
2. *Slices.*  A group's counts within one term block are a slice.  Slices are replicated to the
   cells that need them: as often as the language has group blocks.
3. *Cells* make their slices dense (at most 2 x ``GROUP_BLOCK`` groups by about ``TERM_BLOCK``
   terms) and give the partial divergence of every pair of groups; cells on the diagonal also
   give each group's leading terms against its language.
4. *Reduction along the term axis*: partial divergences are summed, leading terms ranked anew.

A term that no group of a cell uses adds the same to a pair as any other such term, so cells
hold used terms only and the rest is added once per pair.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagweave.llm.common import map_arrow
from tagweave.session import cut_lineage

#: Groups and terms along the edges of a cell, about (both are dealt by hash).
GROUP_BLOCK, TERM_BLOCK = 64, 4096
#: Terms a task counts before it hands them on (bounds memory, not results).
HELD_TERMS = 300_000
#: Groups whose totals are sent to every task at most; more are joined by a shuffle.
BROADCAST_GROUPS = 50_000
#: Parts per one of a probability, and what is added to every count.
SCALE, ADDED = 1_000_000_000, 5

#: Byte translation: A-Z lower-cased, other letters' bytes kept, everything else a blank.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode().translate(TERM_BYTES).split()


def group_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``, summed within tasks; an empty term marks that a group occurs."""
    names = ("lang", "source", "term", "n", "docs")

    def handed_on(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs_with) in held.items():
            terms = list(n)
            for at in range(0, len(terms) + 1, 20_000):
                part = terms[at:at + 20_000]
                columns = [[t.decode() for t in part], [n[t] for t in part], [docs_with[t] for t in part]]
                if at == 0:
                    for column, first in zip(columns, ("", 0, 0)):
                        column.append(first)
                size = len(columns[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()),
                     pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()),
                     pa.array(columns[2], pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        entries = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                n, docs_with = held.setdefault((lang, source), (Counter(), Counter()))
                terms = terms_of(text)
                before = len(n)
                n.update(terms)
                docs_with.update(set(terms))
                entries += len(n) - before
                if entries > HELD_TERMS:
                    yield from handed_on(held)
                    held, entries = {}, 0
        yield from handed_on(held)

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return map_arrow(docs.select(blank("lang"), blank("source"), blank("text")), run,
                     "lang string, source string, term string, n long, docs long")


def kept_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """``lang, source, term, n, in_lang, lead``: counts of the terms in at least ``min_docs`` documents
    of their language, the count there, and one ``lead`` row per language and term.

    Every group also has a row with an empty term.
    """
    # Marks are dealt by group, so that a language with many of them is no hot key.
    mark = F.when(F.col("term") == "", F.col("source")).otherwise("")
    summed = group_counts(docs).withColumn("mark", mark).repartition("lang", "term", "mark") \
        .groupBy("lang", "term", "mark", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term", "mark")
    found = summed.select("lang", "source", "term", "n", F.sum("n").over(term).alias("in_lang"),
                          F.sum("docs").over(term).alias("in_docs"),
                          (F.col("source") == F.min("source").over(term)).alias("lead"))
    return found.filter((F.col("in_docs") >= min_docs) | (F.col("term") == "")).drop("in_docs")


def scaled(x: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """floor(SCALE * x / whole) for 0 <= x <= whole < 9.2e15, without leaving 64 bits."""
    out, rest = np.zeros(np.broadcast(x, whole).shape, np.int64), x
    for _ in range(3):  # SCALE is 1000 three times over
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out


def cell_divergences(cell: pa.Table, ranks: int) -> pa.Table:
    """Partial divergences of the pairs of groups of one cell, and a diagonal cell's leading terms."""
    lang, low, high, part = (cell.column(c)[0].as_py() for c in ("lang", "low", "high", "part"))
    numbers = lambda t, c: t.column(c).to_numpy()
    marked = np.asarray(cell.column("term").to_pylist(), dtype=object) == ""
    marks, used = cell.filter(pa.array(marked)), cell.filter(pa.array(~marked))
    sources, block = marks.column("source").to_pylist(), numbers(marks, "block")
    kept_terms = int(numbers(marks, "terms")[0])
    whole = np.maximum(numbers(marks, "size") + ADDED * kept_terms, 1)
    whole_lang = max(int(numbers(marks, "total")[0]) + ADDED * kept_terms, 1)

    place = {s: i for i, s in enumerate(sources)}
    rows = np.fromiter((place[s] for s in used.column("source").to_pylist()), np.int64, used.num_rows)
    coded = used.column("term").combine_chunks().dictionary_encode()
    terms, columns = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    counts = np.zeros((len(sources), len(terms)), np.int64)
    counts[rows, columns] = numbers(used, "n")
    p = 1 + scaled(counts + ADDED, whole[:, None])
    unused = 1 + scaled(np.full(len(sources), ADDED, np.int64), whole)

    out: dict[str, list] = {"part": [], "source": [], "item": [], "value": []}

    def put(kind, source, item, value):
        for column, x in zip(out.values(), (kind, source, item, int(value))):
            column.append(x)

    for i in range(len(sources)):
        if low == high:
            others = np.arange(i + 1, len(sources))
        else:
            others = np.flatnonzero(block == high) if block[i] == low else np.zeros(0, np.int64)
        apart = np.abs(unused[others] - unused[i])
        # What this cell's terms add beyond unused ones; the first term block adds all terms as unused.
        value = np.abs(p[others] - p[i]).sum(axis=1) - len(terms) * apart + (kept_terms * apart if part == 0 else 0)
        for j, v in zip(others.tolist(), value.tolist()):
            put("pair", *sorted((sources[i], sources[j])), v if kept_terms else 0)
    if low == high:
        in_lang = np.zeros(len(terms), np.int64)
        in_lang[columns] = numbers(used, "in_lang")
        q = 1 + scaled(in_lang + ADDED, np.int64(whole_lang))
        for i, source in enumerate(sources):
            above = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            f = p[i][above] - q[above]
            if len(f) > ranks:  # ties at the last rank stay until they are ordered
                least = np.partition(f, len(f) - ranks)[len(f) - ranks]
                above, f = above[f >= least], f[f >= least]
            for negative, term in heapq.nsmallest(ranks, zip((-f).tolist(), (terms[t] for t in above.tolist()))):
                put("term", source, term, -negative)
    return pa.table({"lang": pa.array([lang] * len(out["part"]), pa.string()), "part": pa.array(out["part"], pa.string()),
                     "source": pa.array(out["source"], pa.string()), "item": pa.array(out["item"], pa.string()),
                     "value": pa.array(out["value"], pa.int64())})


def audit_sources(docs: DataFrame, min_docs: int = 30, ranks: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every (language, source) group of ``docs``.

    Part ``pair``: every other source of the language with the summed absolute difference of
    the two groups' smoothed term probabilities (in parts of 10^9).  Part ``term``: the
    ``ranks`` terms that the group uses most beyond its language.  Ranks go by value, the
    largest first, then by the item's UTF-8 bytes.

    A null ``lang``, ``source`` or ``text`` counts as empty.  Rows count as documents, so
    repeated rows count as often as they stand there; ids are not read.  A language without kept
    terms has pairs of value 0 and no terms.  A language with one source has no pairs.  Empty
    input: empty.  Exact for up to 9e15 occurrences of kept terms in a language.
    """
    kept = cut_lineage(kept_counts(docs, min_docs))
    real = F.col("term") != ""
    sizes = kept.groupBy("lang", "source").agg(F.sum(F.when(real, F.col("n")).otherwise(0)).alias("size"))
    langs = kept.groupBy("lang").agg(F.sum((real & F.col("lead")).cast("long")).alias("terms"),
                                     F.sum(F.when(real, F.col("n")).otherwise(0)).alias("total"),
                                     F.sum((~real).cast("long")).alias("groups"))
    groups = sizes.join(langs, "lang") \
        .withColumn("blocks", F.ceil(F.col("groups") / GROUP_BLOCK).cast("int")) \
        .withColumn("parts", F.greatest(F.ceil(F.col("terms") / TERM_BLOCK), F.lit(1)).cast("int")) \
        .withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    groups = cut_lineage(groups)
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)

    own = F.pmod(F.xxhash64("term"), F.col("parts")).cast("int")
    slices = kept.join(groups, ["lang", "source"]) \
        .withColumn("part", F.explode(F.when(real, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "part",
                "block", "source", "term", "n", "in_lang", "size", "total", "terms")
    partial = slices.groupBy("lang", "low", "high", "part").applyInArrow(
        lambda cell: cell_divergences(cell, ranks), "lang string, part string, source string, item string, value long")
    # A group pair has one row per term block, a leading term one row in all.
    whole = cut_lineage(partial.groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value")))
    pairs = whole.filter("part = 'pair'")
    back = pairs.select("lang", "part", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs.unionByName(back)).unionByName(ranked(whole.filter("part = 'term'")).filter(F.col("rank") <= ranks))
