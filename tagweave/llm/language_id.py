"""Operator 5: language of a text by multilingual mixture inference.

Training counts letter n-grams (orders 1 to 3, hashed into a fixed number of buckets) per
language over labelled rows.  A document is then taken as a mixture: expectation-maximisation
estimates the proportion of each language from the n-gram likelihoods, and the set of
languages is chosen by penalised likelihood, so a second language must pay for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import map_arrow, map_texts

#: Hash buckets of n-grams; the model is this many doubles per language.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Different labelled texts per language that the model is fitted on, in expectation: a bounded
#: sample, drawn by a hash of the text.  Copies count once, so neither the bound nor the model
#: depends on how often a text stands in the table.
SAMPLE_PER_LANGUAGE = 3000
SMOOTHING = 0.5
EM_TURNS = 12
#: Log-likelihood that each further language must gain per unit of log(n-grams).
PENALTY = 6.0
UNDETERMINED = "und"


@functools.lru_cache(maxsize=2)
def letters(kinds: str = "L") -> np.ndarray:
    """Whether each code point is of the Unicode categories ``kinds``: letters, or with "LM" marks too."""
    return np.fromiter((unicodedata.category(chr(c))[0] in kinds for c in range(0x110000)), bool, 0x110000)


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the letter n-grams; every run of other characters is one space.

    Combining marks count as letters, so vowel signs and accents do not split words.
    """
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters("LM")[code]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first non-letter after a letter stands for its run
    code = np.where(is_letter, code, 32)[keep].astype(np.uint64)
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.concatenate([np.array([32], np.uint64), code, np.array([32], np.uint64)])
    parts = []
    for n in ORDERS:
        h = np.full(len(code) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ code[i:len(code) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        parts.append(h[code[:len(h)] != 32] if n == 1 else h)
    buckets = (np.concatenate(parts) % np.uint64(BUCKETS)).astype(np.int64)
    if len(buckets) < BUCKETS // 16:
        return np.unique(buckets, return_counts=True)
    counts = np.bincount(buckets, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass
class Model:
    """Learned languages (sorted) and log-probabilities, buckets by languages."""
    languages: list[str]
    log_prob: np.ndarray

    def mixture(self, text: str | None) -> tuple[list[str], list[float], float]:
        """The chosen languages, largest first, their proportions in the chosen set, and the score.

        The score is the first one's proportion; for a set of one language what the mixture of
        all languages gave it, so that it tells a clear case from a close one.
        """
        found, counts = ngram_counts(text)
        if not len(found) or not self.languages:
            return [], [], 0.0
        log_p = self.log_prob[found]
        top = log_p.max(axis=1, keepdims=True)
        p = np.exp(log_p - top)

        def fit(columns):
            q = p[:, columns]
            share = np.full(len(columns), 1.0 / len(columns))
            for _ in range(EM_TURNS if len(columns) > 1 else 0):
                joint = q * share
                joint /= joint.sum(axis=1, keepdims=True)
                share = counts @ joint / counts.sum()
            # Likelihood up to a constant shared by all language sets.
            return share, float(counts @ np.log(q @ share + 1e-300))

        every = list(range(len(self.languages)))
        share, _ = fit(every)
        # Ties go to the language that sorts first.
        order = sorted(every, key=lambda i: (-share[i], i))
        chosen, best = None, -np.inf
        for size in range(1, len(order) + 1):
            if size > 1 and share[order[size - 1]] < 0.02:
                break
            columns = order[:size]
            own, fitted = fit(columns)
            value = fitted - PENALTY * (size - 1) * np.log(counts.sum() + 1)
            if value <= best:
                break
            chosen, best = (columns, own), value
        columns, own = chosen
        if len(columns) == 1:
            return [self.languages[columns[0]]], [1.0], min(1.0, float(share[columns[0]]))
        ranked = sorted(range(len(columns)), key=lambda i: (-own[i], columns[i]))
        shares = [float(own[i]) for i in ranked]
        return [self.languages[columns[i]] for i in ranked], shares, min(1.0, shares[0])


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Model from ``labelled`` (``text``, ``lang``); rows with a null in either are left out.

    Fitted on an expected ``per_language`` different texts of each language at most, each taken
    once however many copies it has (told apart by 64-bit hashes; copies meet in their task
    first).  The driver receives one row per language and bucket that occurs.  No labelled rows:
    a model without languages, which predicts ``und`` throughout.
    """
    rows = labelled.select("lang", "text").filter("text is not null and lang is not null") \
        .withColumn("hash", F.xxhash64("text"))
    size = {r["lang"]: r["n"] for r in rows.select("lang", "hash").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(size)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)))
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, per_language / size[lang])))])
    draw = F.pmod("hash", F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.filter(draw < share[F.col("lang")]).groupBy("lang", "hash").agg(F.min("text").alias("text")) \
        .select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, counts = ngram_counts(text)
                mine = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                mine[found] += counts
        for lang, counts in total.items():
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(found), "bucket": pa.array(found, pa.int64()),
                                              "n": pa.array(counts[found], pa.int64())})

    counted = map_arrow(sample, run, "lang string, bucket long, n long") \
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    column = {lang: i for i, lang in enumerate(languages)}
    at = np.fromiter((column[x] for x in counted["lang"].to_pylist()), np.int64, counted.num_rows)
    table[counted["bucket"].to_numpy(), at] += counted["n"].to_numpy()
    return Model(languages, np.log(table / table.sum(axis=0)))


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` and ``languages`` of every whole text.

    ``languages`` is the chosen set with proportions, largest first, ``lang_pred`` its first and
    ``score`` that of ``Model.mixture``.  Null texts and texts without a letter: ``und``, 0, empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS doubles per language

    def rows():
        m = shared.value

        def run(texts):
            out = {"lang_pred": [], "score": [], "languages": []}
            for t in texts:
                langs, shares, score = m.mixture(t) if has_letter(t) else ([], [], 0.0)
                out["lang_pred"].append(langs[0] if langs else UNDETERMINED)
                out["score"].append(score)
                out["languages"].append([{"lang": a, "share": b} for a, b in zip(langs, shares)])
            return out
        return run

    return map_texts(docs, keep, text, "lang_pred string, score double, languages array<struct<lang:string,share:double>>",
                     rows)


def held_out(doc_id: Column) -> Column:
    """Documents kept from training: crc32 of the id as text leaves remainder 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document.

    Learned from the text and non-null ``lang`` of documents that are not held out; ``lang``,
    ``source`` and ``doc_id`` play no part in a prediction.  A null id is not held out.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, model, ["doc_id"]) \
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_determined(docs: DataFrame, min_share: float = 0.5) -> DataFrame:
    """The documents, all columns as they are, in which one language reaches ``min_share``.

    Rejected are texts that are null or hold no letter, and those whose chosen set of languages
    has none with that share of the text; a set of one language has all of it.  Learned from the
    documents' own ``lang`` as in ``identify``.  Where no document has a ``lang``, nothing can be
    told apart: every text with a letter stays.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    whole = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    marked = predict(whole, model, ["__row"])
    return marked.filter(F.get("languages", F.lit(0))["share"] >= min_share).select("__row.*")
