"""Text cleaning as Spark Column expressions.

All functions are Column -> Column, built only from JVM-side functions, so
the whole chain runs in the JVM and works unchanged on a streaming DataFrame.  The order of ``clean_text`` is the reference's:

    spaced commas (H12) -> grouped number (H3) -> email (H4) -> mention (H5)
    -> url (H6) -> number (H7) -> lone ':'/'-' (H8) -> split on whitespace
    -> per word: reduce lengthening (H9), strip backslash (H10), lower (H11)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _only_if(c: Column, needles, rule) -> Column:
    """Run a rule only on texts holding one of ``needles`` (a byte search):
    the rule cannot match elsewhere, so this only skips work.

    A one-element array holds the text: without it every rule would name the
    whole chain before it three times over, and the expression grow as a power."""
    def run(t):
        cond = None
        for n in needles:
            has = F.instr(t, n) > 0
            cond = has if cond is None else cond | has
        return F.when(cond, rule(t)).otherwise(t)
    return F.transform(F.array(c), run)[0]


def strip_quotes(col) -> Column:
    """H1: remove single quotes, double quotes and tabs."""
    return F.translate(_c(col), P.STRIPPED_CHARS, "")


def spaced_commas(col) -> Column:
    """A space before every space, comma and newline.

    This is what the text-only CSV writer (no quoting, space as escape
    character) does to every document before cleaning; it turns each comma
    into its own token later on.
    """
    return F.regexp_replace(_c(col), P.J_CSV_ESCAPED, " $1")


def replace_grouped_number(col) -> Column:
    """H3: ``1,234.5`` style numbers."""
    return _only_if(_c(col), [","], lambda t: F.regexp_replace(t, P.J_GROUPED_NUMBER, P.NUMBER_TOKEN))


def replace_email(col) -> Column:
    """H4: e-mail addresses."""
    return _only_if(_c(col), ["@"], lambda t: F.regexp_replace(t, P.J_EMAIL, P.EMAIL_TOKEN))


def replace_mention(col) -> Column:
    """H5: @user mentions, at most 15 name characters are consumed."""
    return _only_if(_c(col), ["@"], lambda t: F.regexp_replace(t, P.J_MENTION, P.MENTION_TOKEN))


def replace_url(col) -> Column:
    """H6: ``http`` followed by non-whitespace."""
    return _only_if(_c(col), ["http"], lambda t: F.regexp_replace(t, P.J_URL, P.URL_TOKEN))


def replace_number(col) -> Column:
    """H7: any other number (Unicode digits and word boundaries)."""
    return F.regexp_replace(_c(col), P.J_NUMBER, P.NUMBER_TOKEN)


def drop_lone_punct(col) -> Column:
    """H8: a ':' or '-' between whitespace becomes one space."""
    return _only_if(_c(col), [":", "-"], lambda t: F.regexp_replace(t, P.J_LONE_PUNCT, " "))


def normalise_whitespace(col) -> Column:
    """Python ``' '.join(s.split())``: runs of whitespace -> one space, trimmed."""
    return F.trim(F.regexp_replace(_c(col), P.J_WS_RUN, " "))


def reduce_lengthening(col) -> Column:
    """H9: runs of 3+ equal characters shrink to 2 (per word, so not spaces)."""
    return F.regexp_replace(_c(col), P.J_LENGTHENING, "$1$1")


def strip_backslash(col) -> Column:
    """Drop a word's leading backslash before a word character and its
    trailing backslash after one."""
    return _only_if(_c(col), ["\\"], lambda t: F.regexp_replace(
        F.regexp_replace(t, P.J_LEAD_BACKSLASH, ""), P.J_TRAIL_BACKSLASH, ""))


def word_corrections(col) -> Column:
    """H11 on an already whitespace-normalised string: H9, H10, lower-case."""
    return F.lower(strip_backslash(reduce_lengthening(col)))


def clean_text(col, spaced: bool = True) -> Column:
    """H12 + H3..H11 in the reference's order."""
    c = _c(col)
    if spaced:
        c = spaced_commas(c)
    c = replace_grouped_number(c)
    c = replace_email(c)
    c = replace_mention(c)
    c = replace_url(c)
    c = replace_number(c)
    c = drop_lone_punct(c)
    c = normalise_whitespace(c)
    return word_corrections(c)


def words(col) -> Column:
    """Split a cleaned text into its words; an empty text has no words."""
    c = _c(col)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, " "))


# ---------------------------------------------------------------------------
# DuckDB forms of the same rules, used by the oracle SQL.
# ---------------------------------------------------------------------------

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_strip_quotes(x: str) -> str:
    return f"translate({x}, '''\"' || chr(9), '')"


def sql_spaced_commas(x: str) -> str:
    return f"regexp_replace({x}, '([ ,\n])', ' \\1', 'g')"


def sql_rule(x: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({x}, {_q(pattern)}, {_q(repl)}, 'g')"


def sql_normalise_whitespace(x: str) -> str:
    return f"trim(regexp_replace({x}, {_q(P.R_WS_RUN)}, ' ', 'g'))"


def sql_reduce_lengthening(x: str) -> str:
    # RE2 has no back-references: drop every character equal to the two
    # before it.  Works on the space-normalised string (no runs of spaces);
    # the text is split into a character list once so indexing is O(1).
    ch = f"string_split({x}, '')"
    return ("(SELECT array_to_string(list_transform(range(1, len(ch) + 1), lambda i: "
            "CASE WHEN i > 2 AND ch[i] = ch[i - 1] AND ch[i] = ch[i - 2] AND ch[i] <> ' ' "
            "THEN '' ELSE ch[i] END), '') FROM (SELECT " + ch + " AS ch))")


def sql_strip_backslash(x: str) -> str:
    c = f"regexp_replace({x}, {_q(P.R_LEAD_BACKSLASH)}, '\\1\\2', 'g')"
    return f"regexp_replace({c}, {_q(P.R_TRAIL_BACKSLASH)}, '\\1\\2', 'g')"


def sql_clean_steps(x: str, spaced: bool = True) -> list[tuple[str, str]]:
    """The chain as a list of (name, expression) steps; each step reads the
    previous name so the oracle can materialise them as CTE columns."""
    steps = []
    cur = x
    if spaced:
        steps.append(("c_spaced", sql_spaced_commas(cur)))
        cur = "c_spaced"
    for name, pat, rep in [("c_gnum", P.R_GROUPED_NUMBER, P.NUMBER_TOKEN),
                           ("c_email", P.R_EMAIL, P.EMAIL_TOKEN),
                           ("c_user", P.R_MENTION, P.MENTION_TOKEN),
                           ("c_url", P.R_URL, P.URL_TOKEN),
                           ("c_num", P.R_NUMBER, P.NUMBER_TOKEN),
                           ("c_lone", P.R_LONE_PUNCT, " ")]:
        steps.append((name, sql_rule(cur, pat, rep)))
        cur = name
    steps.append(("c_ws", sql_normalise_whitespace(cur)))
    steps.append(("c_len", sql_reduce_lengthening("c_ws")))
    steps.append(("c_bs", sql_strip_backslash("c_len")))
    steps.append(("clean", "lower(c_bs)"))
    return steps
