"""Operator 8: secrets in texts: fixed patterns, and guess-cost of values in credential context.

The fixed patterns find assignments, access keys and long hex runs.  Beyond them, any value
that stands in credential context is priced as a password cracker would: a dynamic programme
finds the cheapest way to cut it into common words, dates, repeats, keyboard walks and
brute-force spans.  A value that stays expensive under the best segmentation is a secret; a
placeholder, an ordinary word or a date is not.

Words are ranked by how often the corpus uses them (outside credential values, so a leaked
password that is copied a thousand times does not become a word); letters that are no known word
are brute force.  Separators and changes of case cut names, calls and addresses into parts:
a value of known parts refers to something and is no secret, whatever its length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import map_arrow, map_texts
from tagweave.session import cut_lineage

#: Span kinds in the order in which they are listed at one start.
KINDS = ("assign", "access", "hex", "guess")
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS, ACCESS_CHARS = 12, 18

#: Words that announce a credential; each match of CONTEXT holds one.
CONTEXT_WORDS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"auth")
CONTEXT = re.compile(
    r"(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret)[_ -]?key"
    r"|credentials?|auth(?:orization)?(?:[_ -]?(?:key|token))?)[\"']?[ \t]*(?:[:=]>?|->|\bis\b)[ \t]*"
    r"(?:bearer )?[\"']?([^\s\"'<>|,;]{6,})", re.IGNORECASE | re.ASCII)

#: log10 guesses from which a value in credential context is a secret.
MIN_LOG_GUESSES = 9.0
#: Longest single segment of a value; longer stretches are several segments.
MAX_SEGMENT = 64

# Words that passwords and placeholders are made of, commonest first.
COMMON_WORDS = (
    "password", "qwerty", "letmein", "welcome", "admin", "login", "master", "dragon", "monkey", "shadow", "sunshine",
    "princess", "football", "baseball", "superman", "trustno", "iloveyou", "whatever", "secret", "token", "user",
    "root", "guest", "test", "demo", "example", "sample", "dummy", "default", "changeme", "change", "none", "null",
    "true", "false", "required", "optional", "missing", "invalid", "your", "here", "value", "string", "text", "name",
    "pass", "word", "key", "api", "access", "private", "public", "auth", "bearer", "hidden", "redacted", "removed",
    "placeholder", "undefined", "unknown", "server", "client", "database", "config", "settings", "environment",
    "love", "hello", "summer", "winter", "spring", "autumn", "monday", "friday", "january", "company", "the", "and",
    "for", "with", "this", "that", "from", "have", "not", "you",
    "http", "https", "www", "com", "org", "net", "path", "file", "url", "get", "set", "env", "process", "config", "function",
    "self", "foo", "bar", "baz", "some", "thing", "method", "class", "type", "data", "header", "request", "response")
WORD_RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys(COMMON_WORDS))}
#: Words of the corpus that are ranked after them at most (a bounded dictionary in every task), how
#: often one must occur, and entries a task counts before it hands them on.
TOP_WORDS, LEAST_COUNT, HELD_WORDS = 100_000, 5, 300_000
STEPS = 8
#: What stands between the parts of names, calls, paths and addresses.
SEPARATORS = re.compile(r"[/.:_\-(){}\[\]=?,;]+")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\dA-Z]+|\d+|[^\w]+")
# Rows of keyboard and number pad, and the alphabet.
WALKS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
LEET = str.maketrans("@4831!05$7", "aabelioss" + "t")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])(?:[-/._]?(?:0?[1-9]|[12]\d|3[01]))?)?"
                  r"|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d")

#: Characters and sizes of the classes that a brute-force guesser draws from; any other: ``OTHERS``.
CLASSES = (("0123456789", 10), ("abcdefghijklmnopqrstuvwxyz", 26), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26),
           ("._-/:", 5), ("!\"#$%&'()*+,;<=>?@[\\]^`{|}~ ", 28))
OTHERS = 100
CLASS_OF = {c: i for i, (chars, _) in enumerate(CLASSES) for c in chars}

#: log10 of what each segment beyond the first costs a guesser.
SEAM = math.log10(2)


def _walk_neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for row in WALKS:
        for a, b in zip(row, row[1:]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for upper, lower in zip(WALKS[:3], WALKS[1:4]):
        for i, c in enumerate(upper[1:] if upper is WALKS[0] else upper):
            if i < len(lower):
                near.setdefault(c, set()).add(lower[i])
                near.setdefault(lower[i], set()).add(c)
    return near


NEIGHBOURS = _walk_neighbours()


WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_ranks(docs: DataFrame, top: int = TOP_WORDS) -> dict[str, int]:
    """Word -> rank: the fixed words, then the commonest words of all texts (3 to 20 letters, A-Z
    lower-cased, at least ``LEAST_COUNT`` places outside credential values; ties by the word).

    Taken are as many whole steps of frequency (``STEPS`` to a doubling) as hold ``top`` words at
    most, so no task sorts or gathers more than that."""
    def handed_on(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
                                          names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                raw = (text or "").encode()
                if any(w in raw.lower() for w in CONTEXT_WORDS):
                    raw = CONTEXT.sub(lambda m: m[0][:m.start(1) - m.start()], text).encode()
                seen.update(w for w in raw.translate(WORD_BYTES).split() if 3 <= len(w) <= 20)
                if len(seen) > HELD_WORDS:
                    yield handed_on(seen)
                    seen = Counter()
        yield handed_on(seen)

    step = F.floor(F.log2("n") * STEPS)
    counted = cut_lineage(map_arrow(docs.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
                          .filter(F.col("n") >= LEAST_COUNT))
    sizes = sorted(((r["step"], r["n"]) for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = None, 0
    for at, n in sizes:  # a row per step of frequency, a few hundred at most
        if held + n > top:
            break
        least, held = at, held + n
    ranks = dict(WORD_RANK)
    found = counted.filter(step >= least).collect() if least is not None else []  # ``held`` words
    for r in sorted(found, key=lambda r: (-r["n"], r["word"])):
        ranks.setdefault(r["word"], len(ranks) + 1)
    return ranks


def _segments(value: str, ranks: dict[str, int]) -> list[list[tuple[int, float]]]:
    """For each start the recognised segments: (end, log10 guesses)."""
    n = len(value)
    low = value.lower()
    plain = low.translate(LEET)
    out: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i + 2, min(n, i + 20) + 1):
            for form, extra in ((low, 0.0), (plain, 1.0)):
                rank = ranks.get(form[i:j])
                if rank:
                    case = 0.0 if value[i:j] == low[i:j] else 0.5
                    out[i].append((j, math.log10(rank + 1) + extra + case))
        # Repeats of a unit of one to four characters.
        for unit in range(1, 5):
            j = i + unit
            while j < n and j - i < MAX_SEGMENT and value[j] == value[j - unit]:
                j += 1
            if j - i >= max(3, 2 * unit):
                out[i].append((j, unit + math.log10(j - i)))
        # Keyboard walks and sequences.
        j = i + 1
        turns = 0
        while j < n and j - i < MAX_SEGMENT and low[j] in NEIGHBOURS.get(low[j - 1], ()):
            if j - i >= 2 and (ord(low[j]) - ord(low[j - 1])) != (ord(low[j - 1]) - ord(low[j - 2])):
                turns += 1
            j += 1
            if j - i >= 3:
                out[i].append((j, 1.7 + 0.35 * turns + math.log10(j - i)))
        for m in (DATE.match(value, i),):
            if m:
                out[i].append((m.end(), 3.9))
    return out


def log_alphabet(value: str) -> float:
    """log10 of the size of all character classes that the value draws from."""
    found = {CLASS_OF.get(c) for c in value}
    return math.log10(sum(OTHERS if i is None else CLASSES[i][1] for i in found)) if found else 0.0


def log_guesses(value: str, each: float = 1.0, ranks: dict[str, int] = WORD_RANK) -> float:
    """log10 of the guesses of the cheapest segmentation of the value.

    ``each`` is the log10 of the guesses of a brute-force character.
    """
    n = len(value)
    best = [0.0] + [math.inf] * n
    found = _segments(value, ranks)
    for i in range(n):
        here = best[i] + (SEAM if i else 0.0)
        if each < math.inf:
            for j in range(i + 1, min(n, i + MAX_SEGMENT) + 1):
                best[j] = min(best[j], here + (j - i) * each)  # brute force
        for j, cost in found[i]:
            best[j] = min(best[j], here + cost)
    return best[n]


def _known(part: str, ranks: dict[str, int]) -> bool:
    """Whether a part of a value is recognised throughout, or too short to say anything."""
    return len(part) <= 2 or log_guesses(part, math.inf, ranks) < math.inf


def is_secret(value: str, ranks: dict[str, int] = WORD_RANK) -> bool:
    """Whether the value stays expensive, brute force priced by the character classes it draws from.

    A value of several parts is a reference if all are known; else its unknown parts are priced.
    """
    each = log_alphabet(value)
    parts = [p for p in SEPARATORS.split(value) if p]
    pieces = [x for p in parts for x in CAMEL.findall(p)]
    if len(pieces) > 1 and all(_known(x, ranks) for x in pieces) and any(len(x) > 2 for x in pieces):
        return log_guesses(value, each, ranks) >= MIN_LOG_GUESSES and not _names(pieces)
    if len(parts) > 1:
        return sum(log_guesses(p, each, ranks) for p in parts if not _known(p, ranks)) >= MIN_LOG_GUESSES
    return log_guesses(value, each, ranks) >= MIN_LOG_GUESSES


def _names(pieces: list[str]) -> bool:
    """Whether pieces read as a name or path: most of their characters stand in pieces of letters."""
    letters = sum(len(x) for x in pieces if x.isalpha() and len(x) > 2)
    return 2 * letters > sum(map(len, pieces))


_HEX_SHAPE = bytes(48 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_HEX_RUN = b"0" * 16


def spans_of(text: str, ranks: dict[str, int] = WORD_RANK) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start and then kind; code points, end exclusive.

    The fixed kinds overlap one another freely; a ``guess`` span is the value alone and is
    added only where no fixed span touches it.
    """
    raw = text.encode()
    low = raw.lower()
    out: list[tuple[int, int, str]] = []
    context = any(w in low for w in CONTEXT_WORDS)
    if context:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if b"AKIA" in raw:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    if _HEX_RUN in raw.translate(_HEX_SHAPE):
        out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if context:
        taken = sorted(out)
        for m in CONTEXT.finditer(text):
            a, b = m.span(1)
            value = m[1].rstrip(".):]}")
            b = a + len(value)
            if len(value) >= 6 and not any(s < b and a < e for s, e, _ in taken) and is_secret(value, ranks):
                out.append((a, b, "guess"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPAN_DDL = "spans array<struct<start:int,end:int,kind:string>>"


def _shared(docs: DataFrame, ranks: dict[str, int] | None):
    """The ranks, learned from the texts unless given, in every task (at most ``TOP_WORDS`` and the fixed words)."""
    return docs.sparkSession.sparkContext.broadcast(word_ranks(docs) if ranks is None else ranks)


def scan(docs: DataFrame, id_cols: list[str] | None = None, ranks: dict[str, int] | None = None) -> DataFrame:
    """``doc_id`` (or ``id_cols``) and ``spans`` of every whole text, one row per input row.

    Words are ranked by the texts themselves unless ``ranks`` is given.  Null text: empty, so no
    spans.  Repeated rows come back repeatedly.
    """
    shared = _shared(docs, ranks)

    def rows():
        return lambda texts: {"spans": [[{"start": a, "end": b, "kind": k} for a, b, k in spans_of(t or "", shared.value)]
                                        for t in texts]}
    return map_texts(docs, id_cols or ["doc_id"], "text", SPAN_DDL, rows)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every whole text."""
    found = scan(docs)
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    counts = [F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))


def redact_text(text: str, mark: str = "[secret]", ranks: dict[str, int] = WORD_RANK) -> str:
    """The text with every span, overlapping ones merged, replaced by ``mark``."""
    out, at = [], 0
    spans = spans_of(text, ranks)
    k = 0
    while k < len(spans):
        start, end, _ = spans[k]
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][1])
            k += 1
        out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mark: str = "[secret]", ranks: dict[str, int] | None = None) -> DataFrame:
    """All columns of ``docs`` with secrets in ``text`` replaced; ``n_chars``, where there, follows.

    Null texts stay null; texts without a secret stay as they are, to the character.
    """
    shared = _shared(docs, ranks)

    def rows():
        return lambda texts: {"__clean": [None if t is None else redact_text(t, mark, shared.value) for t in texts]}
    others = [c for c in docs.columns if c != "text"]
    clean = map_texts(docs, others, "text", "__clean string", rows).withColumnRenamed("__clean", "text")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text"))
                                 .otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)
