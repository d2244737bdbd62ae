"""DuckDB SQL for the oracle check: the same pipeline, written as CTEs.

The tables ``documents``, ``labels``, ``pages`` ... are views in the
checker's DuckDB session.  Every builder returns a full SELECT statement.
"""

from __future__ import annotations

from ..functions import cleaning as C
from ..functions import patterns as P
from ..functions.escapes import sql_unescape_entities
from ..sources.tables import SQL_LABEL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


def chain_ctes(src: str, text: str, steps: list, keep: str) -> tuple[str, str]:
    """Materialise each (name, expr) step as its own CTE column."""
    ctes = []
    prev = src
    for i, (name, expr) in enumerate(steps):
        cte = f"{src}_s{i}"
        ctes.append(f"{cte} AS (SELECT {keep}, {expr} AS {name} FROM {prev})")
        keep_cols = keep + f", {name}"
        keep = keep_cols
        prev = cte
    return ",\n".join(ctes), prev


def tag_case(word: str = "word") -> str:
    parts = [f"WHEN regexp_matches({word}, {q(pat)}) THEN {q(tag)}" for tag, pat in P.TAG_RULES]
    return "CASE " + " ".join(parts) + f" ELSE {q(P.DEFAULT_TAG)} END"


def group_case(tag: str, groups: dict, default: str = "DEFAULT") -> str:
    parts = [f"WHEN {tag} IN {str_list(tags)} THEN {q(name)}" for name, tags in groups.items() if tags]
    if not parts:
        return q(default)
    return "CASE " + " ".join(parts) + f" ELSE {q(default)} END"


def weight_case(grp: str, weights: dict) -> str:
    parts = [f"WHEN {grp} = {q(k)} THEN {float(v)!r}::DOUBLE" for k, v in weights.items()]
    if not parts:
        return "0.0::DOUBLE"
    return "CASE " + " ".join(parts) + " ELSE 0.0::DOUBLE END"


def corpus_ctes(groups: dict, train: float = 0.7, test: float = 0.2, decode: bool = True) -> str:
    """CTEs ending in ``split_docs`` (doc_id, label, split, clean, words),
    ``tokens`` (doc_id, label, split, pos, word, tag) and ``terms``
    (doc_id, label, split, pos, word, grp)."""
    stripped = C.sql_strip_quotes("text")
    if decode:
        stripped = sql_unescape_entities(stripped)
    steps = C.sql_clean_steps("text")
    chain, last = chain_ctes("cl", "text", steps, "doc_id, label")
    return f"""
labelled AS (
  SELECT d.doc_id, d.text, {SQL_LABEL} AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  WHERE d.text IS NOT NULL AND NOT contains(d.text, chr(9))
),
dedup AS (
  SELECT * FROM labelled
  WHERE doc_id IN (SELECT min(doc_id) FROM labelled GROUP BY md5(text))
),
cl AS (SELECT doc_id, label, {stripped} AS text FROM dedup),
{chain},
cleaned AS (SELECT doc_id, label, clean FROM {last}),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM cleaned
),
split_docs AS (
  SELECT doc_id, label, clean,
         CASE WHEN rn < floor({train!r}::DOUBLE * n) THEN 'train'
              WHEN rn < floor((1.0::DOUBLE - {test!r}::DOUBLE) * n) THEN 'dev'
              ELSE 'test' END AS split,
         CASE WHEN clean = '' THEN []::VARCHAR[] ELSE string_split(clean, ' ') END AS words
  FROM numbered
),
tokens AS (
  SELECT doc_id, label, split, pos, word, {tag_case('word')} AS tag
  FROM (SELECT doc_id, label, split, unnest(words) AS word,
               generate_subscripts(words, 1) AS pos FROM split_docs)
),
terms AS (
  SELECT doc_id, label, split, pos, lower(word) AS word, {group_case('tag', groups)} AS grp
  FROM tokens WHERE lower(word) NOT IN {str_list(P.ENGLISH_STOPWORDS)}
)"""


def counts_cte(where: str = "") -> str:
    w = f"WHERE {where}" if where else ""
    return f"""counts AS (
  SELECT doc_id, label, split, word, grp, count(*)::BIGINT AS cnt FROM terms {w}
  GROUP BY doc_id, label, split, word, grp
)"""


def weighted_cte(weights: dict, src: str = "counts") -> str:
    w = weight_case("grp", weights)
    return f"""weighted AS (
  SELECT doc_id, label, split, word, grp, cnt,
         CASE WHEN sum(cnt * {w}) OVER (PARTITION BY doc_id) > 0
              THEN cnt * {w} / sum(cnt * {w}) OVER (PARTITION BY doc_id)
              ELSE 0.0::DOUBLE END AS value
  FROM {src}
)"""


def class_sizes_cte() -> str:
    return """class_sizes AS (
  SELECT label, count(*)::DOUBLE AS n_c, sum(count(*)) OVER ()::DOUBLE AS n
  FROM split_docs WHERE split = 'train' GROUP BY label
)"""


CLASSES = ["negative", "neutral", "positive"]


def ocfs_score_sql(classes=CLASSES, sizes: str = "class_sizes") -> str:
    """The OCFS score of one pivoted row (columns s0, s1, ...: exact class
    sums), evaluated in the same fixed order as the Spark expression, so tied
    features get bit-equal scores in both engines."""
    n_c = [f"(SELECT n_c FROM {sizes} WHERE label = {q(c)})" for c in classes]
    n = f"(SELECT max(n) FROM {sizes})"
    m = "(" + "(0.0::DOUBLE" + "".join(f" + s{i}" for i in range(len(classes))) + ")" * 1 + f" / {n})"
    expr = "0.0::DOUBLE"
    for i in range(len(classes)):
        d = f"(s{i} / {n_c[i]} - {m})"
        expr = f"({expr} + ((1000.0::DOUBLE * ({n_c[i]} / {n})) * {d}) * {d})"
    return expr


def pivot_sql(src: str, keys: str, classes=CLASSES) -> str:
    cols = ", ".join(f"coalesce(sum(value::DECIMAL(38,18)) FILTER (WHERE label = {q(c)}), 0)::DOUBLE AS s{i}"
                     for i, c in enumerate(classes))
    return f"SELECT {keys}, {cols} FROM {src} WHERE split = 'train' GROUP BY {keys}"


def ocfs_cte(src: str = "weighted", keys: str = "word, grp") -> str:
    """Per feature: sum over every training class (present or not) of
    1000 * (n_c / n) * (class mean - corpus mean)^2; class sums in exact
    decimals like the Spark side."""
    return f"""class_sums AS (
  SELECT {keys}, label, sum(value::DECIMAL(38,18)) AS s
  FROM {src} WHERE split = 'train' GROUP BY {keys}, label
),
feat AS (
  SELECT {keys}, sum(s)::DOUBLE AS s_all FROM class_sums GROUP BY {keys}
),
grid AS (
  SELECT f.*, c.label, c.n_c, c.n FROM feat f, class_sizes c
),
pivoted AS ({pivot_sql(src, keys)}),
ocfs AS (SELECT {keys}, {ocfs_score_sql()} AS score FROM pivoted)"""


def percentile_cte(src: str, col: str, rank_pct_expr: str) -> str:
    """Linear percentile by hand (the percentile argument is not constant).  The two order statistics
    come from one pass over the ranks: a join of the ranks with themselves is a cross product when
    the planner puts it before their conditions."""
    return f"""ranked AS (
  SELECT {col} AS v, row_number() OVER (ORDER BY {col}) - 1 AS i, count(*) OVER () AS p FROM {src}
),
pq AS (SELECT ({rank_pct_expr}) / 100.0 * (max(p) - 1) AS h FROM ranked),
ends AS (
  SELECT max(CASE WHEN r.i = floor(pq.h) THEN r.v END) AS lo, max(CASE WHEN r.i = ceil(pq.h) THEN r.v END) AS hi,
         max(pq.h) AS h FROM ranked r, pq
),
cut AS (SELECT CASE WHEN lo = hi THEN lo ELSE lo + (hi - lo) * (h - floor(h)) END AS cut FROM ends)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes if c.strip())
