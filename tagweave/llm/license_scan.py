"""Operator 4: licence phrases and notices by a positional index of rare licence words.

Templates (short licence notices) and fixed phrases are indexed by word: a posting is a
template and a position in it.  A first pass over the corpus counts in how many documents each
licence word stands.  For a file, its licence words of highest inverse document frequency are
looked up; occurrences that agree on where a template would begin (position in the file minus
position in the template) are intersected, and an alignment counts only if the template's
mandatory key phrases stand, word for word, at their places.  The score of an alignment is the
share of the template's IDF mass that stands in place.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import map_arrow, map_texts

# Phrases that label a text wherever their words stand consecutively.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Opening words of public licence notices; label, mandatory key phrase, notice.
NOTICES = (
    ("mit", "permission is hereby granted free of charge",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license",
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
     "the license you may obtain a copy of the license at"),
    ("gpl-3", "gnu general public license version 3", "under the gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2", "under the gnu general public license version 2"),
    ("gpl", "terms of the gnu general public license",
     "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
     "free software foundation"),
    ("lgpl", "gnu lesser general public license",
     "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "gnu affero general public license",
     "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2", "mozilla public license",
     "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms",
     "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software",
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted"),
    ("cc-by", "creative commons attribution 4 0",
     "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal public domain dedication"),
    ("unlicense", "released into the public domain",
     "this is free and unencumbered software released into the public domain"),
)

#: Rarest words of a notice that are looked up before an alignment is scored in full.  Only the
#: work depends on it: an alignment goes if the words that do not stand rule its score out.
LOOKUPS = 12
#: Least share of a notice's IDF mass that must stand in place.
MIN_SCORE = 0.75

#: Byte translation: A-Z lower-cased; ASCII that is neither letter nor digit becomes a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
                   for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode().translate(WORD_BYTES).split()


@dataclass
class Template:
    """A licence notice or phrase: its words, and the key phrase with its place in it."""
    label: str
    words: list[bytes]
    key: list[bytes]
    base: bool
    key_at: int = field(init=False)

    def __post_init__(self):
        n = len(self.key)
        places = [i for i in range(len(self.words) - n + 1) if self.words[i:i + n] == self.key]
        if not places:
            raise ValueError(f"the key phrase of {self.label} does not stand in its notice")
        self.key_at = places[0]


def templates(phrases=BASE_PHRASES, notices=NOTICES) -> list[Template]:
    base = [Template(label, words_of(p), words_of(p), True) for p, label in phrases]
    return base + [Template(label, words_of(text), words_of(key), False) for label, key, text in notices]


def document_frequencies(docs: DataFrame, vocabulary: list[bytes]) -> tuple[int, dict[bytes, int]]:
    """Documents, and documents holding each licence word, over the whole corpus.

    Tasks pre-aggregate; what reaches the driver is one number per licence word.
    """
    names = [w.decode() for w in vocabulary]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozenset(vocabulary)
        seen: Counter = Counter()
        total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += 1
                seen.update(known.intersection((text or "").encode().translate(WORD_BYTES).split()))
        rows = [("", total)] + [(w.decode(), n) for w, n in seen.items()]
        yield pa.RecordBatch.from_pydict({"word": [r[0] for r in rows], "n": pa.array([r[1] for r in rows], pa.int64())})

    parts = map_arrow(docs.select("text"), run, "word string, n long")
    got = {r["word"]: r["n"] for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got.get("", 0), {w.encode(): got.get(w, 0) for w in names}


class Index:
    """Positional index of the templates with corpus IDF weights."""

    def __init__(self, made: list[Template], total: int, df: dict[bytes, int]):
        self.templates = made
        self.idf = {w: math.log((total + 1) / (n + 1)) + 1e-6 for w, n in df.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.mass, self.anchor, self.key_words, self.looked_up = [], [], [], []
        for t, template in enumerate(made):
            for q, w in enumerate(template.words):
                self.postings[w].append((t, q))
            self.mass.append(sum(self.idf[w] for w in template.words))
            rare = max(range(len(template.key)), key=lambda i: (self.idf[template.key[i]], -i))
            self.anchor.append((template.key[rare], template.key_at + rare))
            self.key_words.append(frozenset(template.key))
            rarest = sorted(set(template.words), key=lambda w: (-self.idf[w], w))[:LOOKUPS]
            self.looked_up.append([(w, q) for w in rarest for tt, q in self.postings[w] if tt == t])
        # Rarest word of each key phrase: without one of them no template can stand.
        self.doors = frozenset(w for w, _ in self.anchor)

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, score) of every verified alignment; starts may lie before the text."""
        present = frozenset(words).intersection(self.idf)
        if not present & self.doors:
            return []
        open_to = {t for t, key in enumerate(self.key_words) if key <= present}
        if not open_to:
            return []
        wanted = {w for t in open_to for w, _ in self.looked_up[t]} | {self.anchor[t][0] for t in open_to}
        places: dict[bytes, list[int]] = defaultdict(list)
        for p, w in enumerate(words):
            if w in wanted:
                places[w].append(p)
        # Candidate beginnings: every occurrence of a template's rarest key word (so no place of a
        # key phrase is missed), as far as the rare words that stand at the same relative place
        # leave enough of the notice's mass.
        found = []
        for t in sorted(open_to):
            template = self.templates[t]
            word, q = self.anchor[t]
            starts = {p - q for p in places[word]}
            if not template.base and starts:
                agreed: Counter = Counter()
                for w, qq in self.looked_up[t]:
                    for s in starts.intersection(p - qq for p in places[w]):
                        agreed[s] += self.idf[w]
                sought = sum(self.idf[w] for w, _ in self.looked_up[t])
                starts = {s for s in starts if self.mass[t] - sought + agreed[s] >= MIN_SCORE * self.mass[t] - 1e-9}
            for s in sorted(starts):
                a = s + template.key_at
                if a < 0 or words[a:a + len(template.key)] != template.key:
                    continue
                stands = sum(self.idf[w] for i, w in enumerate(template.words)
                             if 0 <= s + i < len(words) and words[s + i] == w)
                score = stands / self.mass[t] if self.mass[t] else 1.0
                if template.base or score >= MIN_SCORE:
                    found.append((t, s, min(1.0, score)))
        return found


def scan_licenses(docs: DataFrame, phrases=BASE_PHRASES, notices=NOTICES) -> DataFrame:
    """Licence findings of every whole text, one row per input row.

    ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places``:
    ``n_base`` counts all places of the fixed phrases, ``first_word`` / ``last_word`` are their
    least and greatest starts (null without one), labels are distinct, sorted and joined by
    commas (empty without one), ``score`` is the best alignment's (0 without one), ``places``
    lists every alignment (label, start, fixed phrase or not).  Null text: empty.
    """
    made = templates(phrases, notices)
    vocabulary = sorted({w for t in made for w in t.words})
    total, df = document_frequencies(docs, vocabulary)

    def rows():
        index = Index(made, total, df)

        def run(texts):
            out = defaultdict(list)
            for text in texts:
                words = words_of(text)
                found = index.scan(words)
                base = [(made[t].label, s) for t, s, _ in found if made[t].base]
                out["n_words"].append(len(words))
                out["n_base"].append(len(base))
                out["first_word"].append(min((s for _, s in base), default=None))
                out["last_word"].append(max((s for _, s in base), default=None))
                out["base_labels"].append(",".join(sorted({x for x, _ in base})))
                out["labels"].append(",".join(sorted({made[t].label for t, _, _ in found})))
                out["score"].append(max((x for _, _, x in found), default=0.0))
                out["places"].append([{"label": made[t].label, "start": s, "base": made[t].base} for t, s, _ in found])
            return out
        return run

    return map_texts(docs, ["doc_id"], "text",
                     "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
                     "score double, places array<struct<label:string,start:long,base:boolean>>", rows)
