"""Character references and escapes, as Column expressions.

A text is cut before every ``&`` (or backslash); the reference at a piece's start is read by one
pattern, looked up or computed, and the pieces are joined again.  Texts without the character are
passed through.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = r"^&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
ESCAPE = r"^\\(u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2})"
LAST = 0x10FFFF
UNKNOWN = "\ufffd"


def _character(n: Column) -> Column:
    """The character of a code point that is no surrogate."""
    above = n - 0x10000
    pair = ((above.bitwiseAND(0x3FFC00) * 64) + above.bitwiseAND(0x3FF)) + 0xD800DC00
    units = F.when(n < 0x10000, F.lpad(F.hex(n), 4, "0")).otherwise(F.hex(pair))
    return F.decode(F.unhex(units), "UTF-16BE")


def _number(digits: Column, base: int) -> Column:
    """The number that ``digits`` write, or one above the last code point where they are too many."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.length(short) > 8, F.lit(LAST + 1)).otherwise(F.conv(short, base, 10).cast("long"))


def _surrogate(n: Column) -> Column:
    return n.between(0xD800, 0xDFFF)


def _referenced(n: Column) -> Column:
    """What a numeric reference stands for in HTML5: 128 to 159 are read as Windows-1252 where that has a
    character, controls and non-characters vanish, what is no character becomes U+FFFD."""
    windows = "".join(bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0))
    vanish = (n.between(0x01, 0x08) | n.between(0x0E, 0x1F) | n.isin(0x0B, 0x7F) | n.between(0xFDD0, 0xFDEF)
              | (n.bitwiseAND(0xFFFE) == 0xFFFE))
    return (F.when((n == 0) | _surrogate(n) | (n > LAST), F.lit(UNKNOWN))
            .when(n.between(0x80, 0x9F), F.substring(F.lit(windows), (n - 0x7F).cast("int"), 1))
            .when(vanish, F.lit("")).otherwise(_character(n)))


def _named(ref: Column) -> Column:
    """A named reference; of an unknown one the longest start that may stand without a semicolon."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    bare = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
    start = F.regexp_extract(ref, f"^({'|'.join(bare)})", 1)
    rest = F.substring(ref, F.length(start) + 1, F.length(ref))
    return F.coalesce(F.try_element_at(names, ref),
                      F.when(start != "", F.concat(F.try_element_at(names, start), rest)), F.concat(F.lit("&"), ref))


def _replaced(text: Column, mark: str, pattern: str, meaning) -> Column:
    """``text`` with each match of ``pattern`` (which begins with ``mark``, and has no other) replaced by the
    ``meaning`` of its first group."""
    found = F.transform(F.split(text, f"(?={mark})"), lambda p: F.struct(p.alias("p"), F.regexp_extract(p, pattern, 1).alias("ref")))
    return F.array_join(F.transform(found, lambda f: F.when(f["ref"] == "", f["p"]).otherwise(
        F.concat(meaning(f["ref"]), F.substring(f["p"], F.length(f["ref"]) + 2, F.length(f["p"]))))), "")


def decode_entities(text: Column) -> Column:
    """H2: HTML5 references (named, decimal and hexadecimal); null stays null."""
    def meaning(ref):
        digits = F.regexp_replace(ref, "[#xX;]", "")
        number = F.when(ref.rlike("^#[xX]"), _number(digits, 16)).otherwise(_number(digits, 10))
        # a one-element array holds the number: computed once, not at every use
        numeric = F.transform(F.array(number), _referenced)[0]
        return F.when(ref.startswith("#"), numeric).otherwise(_named(ref))
    return F.when(text.rlike("&[^\\t\\n\\f <&;]"), _replaced(text, "&", REFERENCE, meaning)).otherwise(text)


def repair_escapes(text: Column) -> Column:
    r"""``\uXXXX``, ``\UXXXXXXXX`` and ``\xNN`` escapes only; other text, also non-ASCII, stays.  Escapes of
    surrogates and of numbers above the last code point stay as written; null stays null."""
    def meaning(ref):
        number = F.array(_number(F.substring(ref, 2, 8), 16))
        return F.transform(number, lambda n: F.when(_surrogate(n) | (n > LAST), F.concat(F.lit("\\"), ref))
                           .otherwise(_character(n)))[0]
    return F.when(text.rlike(r"\\[uUx]"), _replaced(text, r"\\", ESCAPE, meaning)).otherwise(text)


# The entities that the oracle's SQL form decodes, those that the
# test tables hold (``&amp;`` last, as a single-pass decoder would have it).
SQL_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"),
]


# References and escapes of every kind and what they stand for, for checks.
ESCAPE_SAMPLE = (" \\u00e9\\x41\\U0001F600\\n ", " éA😀\\n ")
ENTITY_SAMPLE = (" &eacute;&#8217;&#x2026;&hellip;&lt;&notin; ", " é’……<∉ ")


def sql_unescape_entities(x: str) -> str:
    for ent, ch in SQL_ENTITIES:
        x = f"replace({x}, '{ent}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return x
