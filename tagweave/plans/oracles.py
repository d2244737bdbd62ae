"""DuckDB oracle SQL for every registered query that SQL can express."""

from __future__ import annotations

import re

from ..functions import cleaning as C
from ..functions import patterns as P
from ..functions.escapes import ENTITY_SAMPLE, ESCAPE_SAMPLE, sql_unescape_entities
from . import oracle_sql as O
from ..functions import naming as NM
from ..operators import search as R
from ..sources.tables import SQL_LABEL
from . import queries as QQ
from .queries import GROUPS, N_DELETE, TOP_K, WEIGHTS

LABELS = P.LABELS
REPORT_LABELS = ["neutral", "positive", "negative"]


def _per_doc(expr_of_text: str, table: str = "documents", key: str = "doc_id", col: str = "text") -> str:
    return f"SELECT {key}, {expr_of_text.replace('{x}', col)} AS text_out FROM {table}"


def _rule(pattern, repl):
    return C.sql_rule("{x}", pattern, repl)


def _clean_text_sql() -> str:
    steps = C.sql_clean_steps("text")
    chain, last = O.chain_ctes("cl", "text", steps, "doc_id")
    return (f"WITH cl AS (SELECT doc_id, {C.sql_strip_quotes('text')} AS text FROM documents),\n{chain}\n"
            f"SELECT doc_id, clean FROM {last}")


def _corpus(*extra: str) -> str:
    return O.with_(O.corpus_ctes(GROUPS), *extra)


def top_ocfs_terms() -> str:
    return _corpus(O.counts_cte("split = 'train'"), O.weighted_cte(WEIGHTS), O.class_sizes_cte(),
                   O.ocfs_cte()) + f"""
SELECT word, grp, round(score, 6) AS score FROM ocfs
ORDER BY round(score, 6) DESC, word, grp LIMIT {TOP_K}"""



BASE = f"""
labelled AS (
  SELECT d.doc_id, d.text, {SQL_LABEL} AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  WHERE d.text IS NOT NULL AND NOT contains(d.text, chr(9))
),
dedup AS (
  SELECT * FROM labelled WHERE doc_id IN (SELECT min(doc_id) FROM labelled GROUP BY md5(text))
),
numbered AS (
  SELECT doc_id, label, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM dedup
)"""

SHUF = "substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 15)"


def class_distribution():
    return f"""WITH labelled AS (SELECT d.doc_id, {SQL_LABEL} AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT label, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS share_pct
FROM labelled GROUP BY label"""


def balance_classes():
    return f"""WITH {BASE}
SELECT doc_id, label FROM (
  SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {SHUF}, doc_id) AS r FROM dedup)
WHERE r <= (SELECT min(c) FROM (SELECT count(*) AS c FROM dedup GROUP BY label))"""


def shuffle_index():
    return f"""WITH {BASE}
SELECT doc_id, label, row_number() OVER (ORDER BY {SHUF}, doc_id) - 1 AS row_index FROM dedup"""


def split_by_position():
    return f"""WITH {BASE}
SELECT doc_id, label, CASE WHEN rn < floor(0.7::DOUBLE * n) THEN 'train'
                           WHEN rn < floor((1.0::DOUBLE - 0.2::DOUBLE) * n) THEN 'dev' ELSE 'test' END AS split
FROM numbered"""


def row_range():
    return f"""WITH {BASE}
SELECT doc_id, label FROM numbered WHERE rn >= n // 10 AND rn < (9 * n) // 10"""


def union_sources():
    return """SELECT 'documents' AS src, doc_id AS id, length(text)::BIGINT AS n_chars FROM documents
UNION ALL SELECT 'benchmark', item_id, length(text)::BIGINT FROM benchmark
UNION ALL SELECT 'conversations', conv_id, length(text)::BIGINT FROM conversations"""


def tagset_values():
    rows = ", ".join(f"({O.q(t)}, {O.q(d)}, {O.q(f)})" for t, d, f in P.TAGSET)
    return f"tagset(tag, description, family) AS (VALUES {rows})"


def _stop_list():
    return "[" + ", ".join(O.q(w) for w in P.ENGLISH_STOPWORDS) + "]"


def tag_tokens():
    return _corpus() + f"""
SELECT doc_id, len(words)::BIGINT AS n_tokens,
       array_to_string(list_transform(words, lambda w: {O.tag_case('w')}), ' ') AS tags
FROM split_docs"""


def tag_stats_by_label():
    return _corpus(tagset_values()) + """
SELECT s.*, t.description, t.family FROM (
  SELECT label, tag, count(*) AS n_tokens, count(DISTINCT word) AS n_types, count(DISTINCT doc_id) AS n_docs
  FROM tokens GROUP BY label, tag) s LEFT JOIN tagset t ON s.tag = t.tag"""


def stopword_filter():
    kept = f"list_filter(words, lambda w: NOT list_contains({_stop_list()}, w))"
    return _corpus() + f"""
SELECT doc_id, len(words)::BIGINT AS n_words, len({kept})::BIGINT AS n_kept,
       array_to_string({kept}, ' ') AS kept
FROM split_docs"""


def group_tags():
    groups = NM.groups_from_weights(QQ.GROUP_WEIGHTS)
    g = O.group_case("t", groups)
    return _corpus() + f"""
SELECT doc_id, array_to_string(list_transform(list_transform(words, lambda w: {O.tag_case('w')}),
                                              lambda t: {g}), ' ') AS groups FROM split_docs"""


def preprocess_docs():
    return _corpus() + """
SELECT s.doc_id, s.label, s.split, count(t.word)::BIGINT AS n_terms,
       coalesce(string_agg(t.word || '/' || t.grp, ' ' ORDER BY t.pos), '') AS terms
FROM split_docs s LEFT JOIN terms t ON s.doc_id = t.doc_id
GROUP BY s.doc_id, s.label, s.split"""


def vocabulary():
    return _corpus(O.counts_cte()) + """
SELECT word, grp, count(*)::BIGINT AS doc_freq, sum(cnt)::BIGINT AS term_freq
FROM counts WHERE split = 'train' GROUP BY word, grp"""


def term_counts():
    return _corpus(O.counts_cte()) + "\nSELECT doc_id, word, grp, cnt FROM counts"


def binary_bow():
    return _corpus() + "\nSELECT DISTINCT doc_id, word, 1.0::DOUBLE AS value FROM tokens"


IDF_CTE = """idf AS (
  SELECT word, grp, count(DISTINCT doc_id)::BIGINT AS df,
         ln((1.0::DOUBLE + (SELECT count(*) FROM split_docs WHERE split = 'train'))
            / (count(DISTINCT doc_id) + 1.0::DOUBLE)) + 1.0 AS idf
  FROM terms WHERE split = 'train' GROUP BY word, grp
)"""

TFIDF_CTE = """tf AS (
  SELECT c.doc_id, c.split, c.word, c.grp, c.cnt * i.idf AS raw FROM counts c JOIN idf i ON c.word = i.word AND c.grp = i.grp
),
tfidf AS (
  SELECT doc_id, split, word, grp, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS value FROM tf
)"""


def idf():
    return _corpus(IDF_CTE) + "\nSELECT word, grp, df, round(idf, 6) AS idf FROM idf"


def tfidf():
    return _corpus(O.counts_cte(), IDF_CTE, TFIDF_CTE) + "\nSELECT doc_id, word, grp, round(value, 6) AS value FROM tfidf"


def pos_weighted_l1():
    return _corpus(O.counts_cte(), O.weighted_cte(WEIGHTS)) + \
        "\nSELECT doc_id, word, grp, round(value, 6) AS value FROM weighted"


def oov_transform():
    return _corpus(O.counts_cte()) + """
SELECT c.doc_id, count(*)::BIGINT AS n_terms, count(v.word)::BIGINT AS n_known
FROM counts c LEFT JOIN (SELECT DISTINCT word, grp FROM counts WHERE split = 'train') v
  ON c.word = v.word AND c.grp = v.grp
WHERE c.split = 'test' GROUP BY c.doc_id"""


def _train_ocfs(*extra):
    return _corpus(O.counts_cte("split = 'train'"), O.weighted_cte(WEIGHTS), O.class_sizes_cte(), O.ocfs_cte(), *extra)


def centroids():
    return _train_ocfs() + """
SELECT g.word, g.grp, g.label, round(coalesce(cs.s, 0)::DOUBLE / g.n_c, 6) AS class_mean,
       round(g.s_all / g.n, 6) AS mean_all
FROM grid g LEFT JOIN class_sums cs ON cs.word = g.word AND cs.grp = g.grp AND cs.label = g.label"""


def ocfs_scores():
    return _train_ocfs() + "\nSELECT word, grp, round(score, 6) AS score FROM ocfs"


def _rank_pct(p="max(p)"):
    return f"round_even(least({N_DELETE}, {p})::DOUBLE / {p} * 100.0::DOUBLE, 0)"


def ocfs_keep():
    return _train_ocfs(O.percentile_cte("ocfs", "score", _rank_pct())) + """
SELECT o.word, o.grp, round(o.score, 6) AS score, o.score >= c.cut AS kept FROM ocfs o, cut c"""


def _combos_cte(combos) -> str:
    rows = []
    for i, w in enumerate(combos):
        for g, v in w.items():
            rows.append(f"({i}, {O.q(g)}, {float(v)!r}::DOUBLE)")
    return f"combos(combo_id, grp, w) AS (VALUES {', '.join(rows)})"


def _grid_cte(where: str = "") -> str:
    w = f"WHERE {where}" if where else ""
    return f"""cw AS (
  SELECT c.doc_id, c.label, c.split, c.word, c.grp, c.cnt, k.combo_id, coalesce(x.w, 0.0::DOUBLE) AS wt
  FROM (SELECT * FROM counts {w}) c CROSS JOIN (SELECT DISTINCT combo_id FROM combos) k
  LEFT JOIN combos x ON x.combo_id = k.combo_id AND x.grp = c.grp
),
gvals AS (
  SELECT combo_id, doc_id, label, split, word, grp,
         CASE WHEN sum(cnt * wt) OVER (PARTITION BY combo_id, doc_id) > 0
              THEN cnt * wt / sum(cnt * wt) OVER (PARTITION BY combo_id, doc_id) ELSE 0.0::DOUBLE END AS value
  FROM cw
)"""


def ocfs_grid():
    return _corpus(O.counts_cte(), _combos_cte(QQ.GRID), _grid_cte("split = 'train'"), O.class_sizes_cte(),
                   O.ocfs_cte("gvals", "combo_id, word, grp")) + f"""
SELECT * FROM (
  SELECT combo_id::BIGINT AS combo_id, word, grp, round(score, 6) AS score,
         row_number() OVER (PARTITION BY combo_id ORDER BY round(score, 6) DESC, word, grp) AS rank
  FROM ocfs) WHERE rank <= {TOP_K}"""


def block_union():
    b = QQ.BLOCKS
    sql = _train_ocfs(O.percentile_cte("ocfs", "score", _rank_pct()), IDF_CTE,
                      O.counts_cte().replace("counts AS", "all_counts AS"),
                      TFIDF_CTE.replace("FROM counts c", "FROM all_counts c"),
                      "kept AS (SELECT o.word, o.grp FROM ocfs o, cut c WHERE o.score >= c.cut)") + f"""
SELECT doc_id, 'bow' AS block, word, grp, round(1.0::DOUBLE * {b['bow']!r}, 6) AS value FROM counts
UNION ALL
SELECT w.doc_id, 'pos', w.word, w.grp, round(w.value * {b['pos']!r}, 6)
FROM weighted w JOIN kept k ON k.word = w.word AND k.grp = w.grp
UNION ALL
SELECT doc_id, 'tfidf', word, grp, round(value * {b['tfidf']!r}, 6) FROM tfidf WHERE split = 'train'"""
    # read by several branches: computed once
    for name in ("cleaned", "terms", "counts", "all_counts", "weighted", "class_sizes", "ocfs", "ranked", "cut", "kept"):
        sql = re.sub(rf"(?m)^{name} AS \(", f"{name} AS MATERIALIZED (", sql)
    return sql


def _pred_ctes(combos, n_delete, tag=""):
    """Nearest-centroid predictions for every weighting: CTE ``pred{tag}``."""
    t = tag
    return f"""combos{t}(combo_id, grp, w) AS (VALUES {', '.join(f"({i}, {O.q(g)}, {float(v)!r}::DOUBLE)" for i, w in enumerate(combos) for g, v in w.items())}),
cw{t} AS (
  SELECT c.doc_id, c.label, c.split, c.word, c.grp, c.cnt, k.combo_id, coalesce(x.w, 0.0::DOUBLE) AS wt
  FROM counts c CROSS JOIN (SELECT DISTINCT combo_id FROM combos{t}) k
  LEFT JOIN combos{t} x ON x.combo_id = k.combo_id AND x.grp = c.grp
),
gvals{t} AS (
  SELECT combo_id, doc_id, label, split, word, grp,
         CASE WHEN sum(cnt * wt) OVER (PARTITION BY combo_id, doc_id) > 0
              THEN cnt * wt / sum(cnt * wt) OVER (PARTITION BY combo_id, doc_id) ELSE 0.0::DOUBLE END AS value
  FROM cw{t}
),
csum{t} AS (
  SELECT combo_id, word, grp, label, sum(value::DECIMAL(38,18)) AS s FROM gvals{t} WHERE split = 'train'
  GROUP BY combo_id, word, grp, label
),
feat{t} AS (SELECT combo_id, word, grp, sum(s)::DOUBLE AS s_all FROM csum{t} GROUP BY combo_id, word, grp),
sc{t} AS (
  SELECT combo_id, word, grp, {O.ocfs_score_sql()} AS score
  FROM ({O.pivot_sql(f"gvals{t}", "combo_id, word, grp")})
),
rk{t} AS (
  SELECT combo_id, score AS v, row_number() OVER (PARTITION BY combo_id ORDER BY score) - 1 AS i,
         count(*) OVER (PARTITION BY combo_id) AS p FROM sc{t}
),
pq{t} AS (
  SELECT combo_id, round_even(least({n_delete}, max(p))::DOUBLE / max(p) * 100.0::DOUBLE, 0)::DOUBLE / 100.0::DOUBLE
         * (max(p) - 1)::DOUBLE AS h FROM rk{t} GROUP BY combo_id
),
cut{t} AS (
  SELECT q.combo_id, CASE WHEN lo.v = hi.v THEN lo.v ELSE lo.v + (hi.v - lo.v) * (q.h - floor(q.h)) END AS cut
  FROM pq{t} q JOIN rk{t} lo ON lo.combo_id = q.combo_id AND lo.i = floor(q.h)
  JOIN rk{t} hi ON hi.combo_id = q.combo_id AND hi.i = ceil(q.h)
),
model{t} AS (
  SELECT s.combo_id, s.word, s.grp, s.score, c.cut, s.score >= c.cut AS kept FROM sc{t} s JOIN cut{t} c USING (combo_id)
),
means{t} AS (
  SELECT k.combo_id, k.word, k.grp, cs.label, cs.s::DOUBLE / z.n_c AS m
  FROM model{t} k JOIN csum{t} cs ON cs.combo_id = k.combo_id AND cs.word = k.word AND cs.grp = k.grp
  JOIN class_sizes z ON z.label = cs.label WHERE k.kept
),
norms{t} AS (SELECT combo_id, label, sum(m * m) AS nn FROM means{t} GROUP BY combo_id, label),
dots{t} AS (
  SELECT g.combo_id, g.doc_id, m.label, sum(g.value * m.m) AS d
  FROM gvals{t} g JOIN means{t} m ON m.combo_id = g.combo_id AND m.word = g.word AND m.grp = g.grp
  GROUP BY g.combo_id, g.doc_id, m.label
),
dist{t} AS (
  SELECT k.combo_id, s.doc_id, s.label AS gold, s.split, z.label AS cls,
         round(coalesce(n.nn, 0) - 2.0 * coalesce(d.d, 0), 9) AS dd
  FROM split_docs s CROSS JOIN (SELECT DISTINCT combo_id FROM combos{t}) k CROSS JOIN class_sizes z
  LEFT JOIN norms{t} n ON n.combo_id = k.combo_id AND n.label = z.label
  LEFT JOIN dots{t} d ON d.combo_id = k.combo_id AND d.doc_id = s.doc_id AND d.label = z.label
),
pred{t} AS (
  SELECT combo_id, doc_id, gold AS label, split, cls AS prediction FROM (
    SELECT *, row_number() OVER (PARTITION BY combo_id, doc_id ORDER BY dd, cls) AS r FROM dist{t}) WHERE r = 1
)"""


def _pred(*extra, combos=None, n_delete=N_DELETE):
    return _corpus(O.counts_cte(), O.class_sizes_cte(), _pred_ctes(combos or [WEIGHTS], n_delete), *extra)


def _per_class_cte(src, labels, name="pc", by=""):
    lab = ", ".join(f"({O.q(x)})" for x in labels)
    byc = f"{by}, " if by else ""
    return f"""{name}_lab(class) AS (VALUES {lab}),
{name}_cnt AS (
  SELECT {byc}l.class,
         sum(CASE WHEN p.label = l.class AND p.prediction = l.class THEN 1 ELSE 0 END)::BIGINT AS tp,
         sum(CASE WHEN p.prediction = l.class THEN 1 ELSE 0 END)::BIGINT AS pp,
         sum(CASE WHEN p.label = l.class THEN 1 ELSE 0 END)::BIGINT AS support
  FROM {src} p CROSS JOIN {name}_lab l GROUP BY {byc}l.class
),
{name}_p AS (
  SELECT {byc}class, CASE WHEN pp > 0 THEN tp::DOUBLE / pp ELSE 0.0::DOUBLE END AS precision,
         CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0.0::DOUBLE END AS recall, support
  FROM {name}_cnt
),
{name} AS (
  SELECT {byc}class, precision, recall,
         CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1,
         support
  FROM {name}_p
)"""


TEST = "test_pred AS (SELECT * FROM pred WHERE split = 'test')"


def confusion():
    return _pred(TEST) + "\nSELECT label, prediction, count(*) AS n FROM test_pred GROUP BY label, prediction"


def accuracy():
    return _pred() + """
SELECT split, round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy
FROM pred GROUP BY split"""


def per_class_prf():
    return _pred(TEST, _per_class_cte("test_pred", LABELS)) + """
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pc"""


def macro_f1():
    return _pred(TEST, _per_class_cte("test_pred", REPORT_LABELS)) + "\nSELECT round(avg(f1), 6) AS macro_f1 FROM pc"


def classification_report():
    labs = "(" + ", ".join(O.q(x) for x in LABELS) + ")"
    return _pred(TEST, _per_class_cte("test_pred", LABELS)) + f"""
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pc
UNION ALL
SELECT 'micro avg', round(a, 6), round(a, 6), round(a, 6), s FROM (
  SELECT avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a,
         sum(CASE WHEN label IN {labs} THEN 1 ELSE 0 END)::BIGINT AS s FROM test_pred)
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM pc
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM pc"""


def _grid5_ctes() -> list:
    """Class sums and scores of every feature under every weighting of scale 5, one row per weighting
    and term number; values count in whole units of 1e-12 like the Spark side's."""
    weigh = " ".join(f"WHEN {O.q(g)} THEN k.w{i}" for i, g in enumerate(GROUPS))
    units = ", ".join(f"coalesce(sum(floor(value * 1e12 + 0.5::DOUBLE)::HUGEINT) FILTER (WHERE label = {O.q(c)}), 0)::DOUBLE"
                      f" / 1e12 AS s{i}" for i, c in enumerate(O.CLASSES))
    return [f"""weightings(combo_id, {', '.join(f'w{i}' for i in range(len(GROUPS)))}) AS MATERIALIZED (
  SELECT * FROM (VALUES {', '.join(f"({i}, {', '.join(f'{float(w[g])!r}::DOUBLE' for g in GROUPS)})" for i, w in enumerate(QQ.GRID5))})
)""", """vocab AS MATERIALIZED (
  SELECT word, grp, row_number() OVER () AS t FROM (SELECT DISTINCT word, grp FROM counts WHERE split = 'train')
)""", """pairs AS MATERIALIZED (
  SELECT c.doc_id, c.split, c.label, v.t, c.grp, c.cnt FROM counts c JOIN vocab v ON v.word = c.word AND v.grp = c.grp
)""", f"""totals AS MATERIALIZED (
  SELECT p.doc_id, k.combo_id, {' + '.join(f'n{i} * k.w{i}' for i in range(len(GROUPS)))} AS total
  FROM (SELECT doc_id, {', '.join(f"coalesce(sum(cnt) FILTER (WHERE grp = {O.q(g)}), 0)::DOUBLE AS n{i}" for i, g in enumerate(GROUPS))}
        FROM counts GROUP BY doc_id) p CROSS JOIN weightings k
)""", f"""valued AS MATERIALIZED (
  SELECT z.combo_id, p.doc_id, p.split, p.label, p.t,
         CASE WHEN z.total > 0 THEN p.cnt * (CASE p.grp {weigh} ELSE 0.0::DOUBLE END) / z.total ELSE 0.0::DOUBLE END AS value
  FROM pairs p JOIN totals z ON z.doc_id = p.doc_id JOIN weightings k ON k.combo_id = z.combo_id
)""", f"""sums AS MATERIALIZED (SELECT combo_id, t, {units} FROM valued WHERE split = 'train' GROUP BY combo_id, t)""",
            f"""scored AS MATERIALIZED (SELECT combo_id, t, s0, s1, s2, {O.ocfs_score_sql()} AS score FROM sums)"""]


def _cut5_ctes(n_delete: int, tag: str) -> list:
    return [f"""cut{tag} AS MATERIALIZED (
  SELECT combo_id, CASE WHEN lo = hi THEN lo ELSE lo + (hi - lo) * (h - floor(h)) END AS cut FROM (
    SELECT r.combo_id, any_value(q.h) AS h, max(CASE WHEN r.i = floor(q.h) THEN r.score END) AS lo,
           max(CASE WHEN r.i = ceil(q.h) THEN r.score END) AS hi
    FROM (SELECT combo_id, score, row_number() OVER (PARTITION BY combo_id ORDER BY score) - 1 AS i FROM scored) r
    CROSS JOIN (SELECT round_even(least({n_delete}, count(*))::DOUBLE / count(*) * 100.0::DOUBLE, 0) / 100.0::DOUBLE
                       * (count(*) - 1) AS h FROM vocab) q
    GROUP BY r.combo_id)
)"""]


def _runs5_sql() -> str:
    """All runs of scale 5, both feature cuts."""
    ctes = [O.counts_cte().replace("counts AS (", "counts AS MATERIALIZED ("),
            O.class_sizes_cte().replace("class_sizes AS (", "class_sizes AS MATERIALIZED ("), *_grid5_ctes()]
    labels = ", ".join(f"({i}, {O.q(R.weights_label(w))})" for i, w in enumerate(QQ.GRID5))
    ctes.append(f"wlabels(combo_id, weights) AS (SELECT * FROM (VALUES {labels}))")
    parts = []
    for j, n_del in enumerate(QQ.SEARCH_DELETES):
        t = f"_{j}"
        mean = [f"(s.s{i} / (SELECT n_c FROM class_sizes WHERE label = {O.q(c)}))" for i, c in enumerate(O.CLASSES)]
        ctes += _cut5_ctes(n_del, t)
        ctes.append(f"""model{t} AS MATERIALIZED (
  SELECT s.combo_id, s.t, {', '.join(f'{m} AS m{i}' for i, m in enumerate(mean))}
  FROM scored s JOIN cut{t} c ON c.combo_id = s.combo_id WHERE s.score >= c.cut AND s.s0 + s.s1 + s.s2 > 0
),
norms{t} AS MATERIALIZED (SELECT combo_id, {', '.join(f'sum(m{i} * m{i}) AS n{i}' for i in range(3))} FROM model{t} GROUP BY combo_id),
dots{t} AS MATERIALIZED (
  SELECT v.combo_id, v.doc_id, {', '.join(f'sum(v.value * m.m{i}) AS d{i}' for i in range(3))}
  FROM valued v JOIN model{t} m ON m.combo_id = v.combo_id AND m.t = v.t WHERE v.value > 0 GROUP BY v.combo_id, v.doc_id
),
far{t} AS (
  SELECT k.combo_id, s.doc_id, s.label, s.split,
         {', '.join(f'round(coalesce(n.n{i}, 0) - 2.0::DOUBLE * coalesce(d.d{i}, 0), 9) AS x{i}' for i in range(3))}
  FROM split_docs s CROSS JOIN weightings k LEFT JOIN norms{t} n ON n.combo_id = k.combo_id
  LEFT JOIN dots{t} d ON d.combo_id = k.combo_id AND d.doc_id = s.doc_id
),
pred{t} AS MATERIALIZED (
  SELECT combo_id, doc_id, label, split, CASE WHEN x0 <= x1 AND x0 <= x2 THEN {O.q(O.CLASSES[0])}
         WHEN x1 <= x2 THEN {O.q(O.CLASSES[1])} ELSE {O.q(O.CLASSES[2])} END AS prediction FROM far{t}
)""")
        ctes.append(_per_class_cte(f"(SELECT * FROM pred{t} WHERE split = 'test')", REPORT_LABELS, f"pcr{t}", "combo_id"))
        name = NM.run_name(GROUPS, QQ.SEARCH_SCALE, n_del, QQ.SEARCH_BLOCKS, 0.7, 0.2)
        share = lambda split: ("avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) "  # noqa: E731
                               f"FILTER (WHERE split = '{split}')")
        parts.append(f"""SELECT a.combo_id::BIGINT AS combo_id, wl.weights, round(a.train_acc, 6) AS train_acc,
       round(a.test_acc, 6) AS test_acc, round(f.macro_f1, 6) AS macro_f1, {n_del}::BIGINT AS n_delete, {O.q(name)} AS run_name
FROM (SELECT combo_id, {share('train')} AS train_acc, {share('test')} AS test_acc FROM pred{t} GROUP BY combo_id) a
JOIN (SELECT combo_id, avg(f1) AS macro_f1 FROM pcr{t} GROUP BY combo_id) f ON f.combo_id = a.combo_id
JOIN wlabels wl ON wl.combo_id = a.combo_id""")
    return _corpus(*ctes, "runs AS MATERIALIZED (" + "\nUNION ALL\n".join(parts) + ")")


def search_runs_scale5():
    return _runs5_sql() + "\nSELECT * FROM runs"


def leaderboard_scale5():
    lists = "UNION ALL ".join(f"SELECT *, '{metric}' AS metric, {column} AS score FROM runs "
                              for metric, column in R.METRICS.items())
    return _runs5_sql() + f""",
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_name, metric ORDER BY score DESC, combo_id) AS r FROM ({lists}))
  WHERE r = 1
)
SELECT metric, run_name, combo_id, weights, train_acc, test_acc, macro_f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY score DESC, run_name) AS place FROM best) WHERE place <= 10"""


def top_runs_scale5():
    lists = "UNION ALL ".join(f"SELECT *, '{metric}' AS metric, {column} AS score FROM runs "
                              for metric, column in R.METRICS.items())
    return _runs5_sql() + f"""
SELECT run_name, metric, rank, combo_id, weights, train_acc, test_acc, macro_f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY run_name, metric ORDER BY score DESC, combo_id) AS rank FROM ({lists}))
WHERE rank <= 20"""


def weight_grid_scale5():
    labels = ", ".join(f"({i}, {O.q(R.weights_label(w))})" for i, w in enumerate(QQ.GRID5))
    return _corpus(O.counts_cte().replace("counts AS (", "counts AS MATERIALIZED ("),
                   O.class_sizes_cte().replace("class_sizes AS (", "class_sizes AS MATERIALIZED ("), *_grid5_ctes(),
                   *_cut5_ctes(N_DELETE, "_0"), f"wlabels(combo_id, weights) AS (SELECT * FROM (VALUES {labels}))") + """
SELECT s.combo_id::BIGINT AS combo_id, any_value(l.weights) AS weights, count(*) AS n_features,
       sum(CASE WHEN s.score >= c.cut THEN 1 ELSE 0 END)::BIGINT AS n_kept
FROM scored s JOIN cut_0 c ON c.combo_id = s.combo_id JOIN wlabels l ON l.combo_id = s.combo_id GROUP BY s.combo_id"""


def ocfs_grid_scale5():
    return _corpus(O.counts_cte().replace("counts AS (", "counts AS MATERIALIZED ("),
                   O.class_sizes_cte().replace("class_sizes AS (", "class_sizes AS MATERIALIZED ("), *_grid5_ctes()) + f"""
SELECT * FROM (
  SELECT s.combo_id::BIGINT AS combo_id, v.word, v.grp, floor(s.score * 1e6 + 0.5::DOUBLE) / 1e6 AS score,
         row_number() OVER (PARTITION BY s.combo_id ORDER BY floor(s.score * 1e6 + 0.5::DOUBLE) / 1e6 DESC, v.word, v.grp) AS rank
  FROM scored s JOIN vocab v ON v.t = s.t) WHERE rank <= {TOP_K}"""


def wrong_predictions():
    return _pred(TEST) + """
SELECT label, rank, doc_id, prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS rank
  FROM test_pred WHERE label <> prediction) WHERE rank <= 5"""


def _runs_sql():
    """All search runs: both feature-cut settings over the whole grid."""
    parts = []
    ctes = [O.counts_cte(), O.class_sizes_cte()]
    labels = ", ".join(f"({i}, {O.q(R.weights_label(w))})" for i, w in enumerate(QQ.GRID))
    ctes.append(f"wlabels(combo_id, weights) AS (VALUES {labels})")
    for j, n_del in enumerate(QQ.SEARCH_DELETES):
        t = f"_{j}"
        ctes.append(_pred_ctes(QQ.GRID, n_del, t))
        ctes.append(_per_class_cte(f"(SELECT * FROM pred{t} WHERE split = 'test')", REPORT_LABELS, f"pcr{t}", "combo_id"))
        name = NM.run_name(GROUPS, 2, n_del, QQ.SEARCH_BLOCKS, 0.7, 0.2)
        parts.append(f"""SELECT a.combo_id::BIGINT AS combo_id, wl.weights, round(a.train_acc, 6) AS train_acc,
       round(a.test_acc, 6) AS test_acc, round(f.macro_f1, 6) AS macro_f1, {n_del}::BIGINT AS n_delete,
       {O.q(name)} AS run_name
FROM (SELECT combo_id,
             avg(CASE WHEN split = 'train' THEN (CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) END)::DOUBLE AS train_acc,
             avg(CASE WHEN split = 'test' THEN (CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) END)::DOUBLE AS test_acc
      FROM pred{t} GROUP BY combo_id) a
JOIN (SELECT combo_id, avg(f1) AS macro_f1 FROM pcr{t} GROUP BY combo_id) f ON f.combo_id = a.combo_id
JOIN wlabels wl ON wl.combo_id = a.combo_id""")
    ctes.append("runs AS (" + "\nUNION ALL\n".join(parts) + ")")
    return ctes


def _runs(*extra):
    return _corpus(*_runs_sql(), *extra)


def search_runs():
    return _runs() + "\nSELECT * FROM runs"


def weight_grid():
    labels = ", ".join(f"({i}, {O.q(R.weights_label(w))})" for i, w in enumerate(QQ.GRID))
    return _corpus(O.counts_cte(), O.class_sizes_cte(), _pred_ctes(QQ.GRID, N_DELETE),
                   f"wlabels(combo_id, weights) AS (VALUES {labels})") + """
SELECT m.combo_id, count(*)::BIGINT AS n_features, sum(CASE WHEN m.kept THEN 1 ELSE 0 END)::BIGINT AS n_kept, wl.weights
FROM model m JOIN wlabels wl ON wl.combo_id = m.combo_id GROUP BY m.combo_id, wl.weights"""


def run_names():
    return _runs() + "\nSELECT run_name, count(*)::BIGINT AS n_runs FROM runs GROUP BY run_name"


def model_names():
    rows = []
    for n_del in QQ.SEARCH_DELETES:
        for i, w in enumerate(QQ.GRID):
            rows.append(f"({i}, {n_del}, {O.q(NM.model_name(w, n_del, QQ.SEARCH_BLOCKS, 0.7))})")
    return _runs(f"mnames(combo_id, n_delete, model_name) AS (VALUES {', '.join(rows)})") + """
SELECT r.run_name, r.combo_id, m.model_name FROM runs r
JOIN mnames m ON m.combo_id = r.combo_id AND m.n_delete = r.n_delete"""


def beats_threshold():
    return _runs() + "\nSELECT * FROM runs WHERE test_acc > 0.5 OR macro_f1 > 0.5"


SAVED = """saved AS (
  SELECT *, 'accuracy' AS metric,
         row_number() OVER (PARTITION BY run_name ORDER BY test_acc DESC, combo_id) AS rank FROM runs
  QUALIFY rank <= 20
  UNION ALL
  SELECT *, 'f1' AS metric,
         row_number() OVER (PARTITION BY run_name ORDER BY macro_f1 DESC, combo_id) AS rank FROM runs
  QUALIFY rank <= 20
)"""


def top_runs():
    return _runs(SAVED) + """
SELECT run_name, metric, rank, combo_id, weights, train_acc, test_acc, macro_f1 FROM saved"""


def saved_runs():
    return _runs(SAVED) + """
SELECT 'plain' AS dataset, run_name AS experiment, metric, rank, combo_id, weights, train_acc, test_acc, macro_f1 FROM saved"""


def tag_tokens_lexicon():
    return _corpus(r"""lexicon AS MATERIALIZED (
  SELECT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)
  GROUP BY lower(w) HAVING count(*) >= 5 AND 10 * sum(CASE WHEN regexp_matches(w, '^[A-Z][a-z]') THEN 1 ELSE 0 END) >= 9 * count(*)
)""") + """
SELECT t.doc_id, (t.pos - 1)::BIGINT AS pos, t.word, CASE WHEN l.word IS NOT NULL THEN '^' ELSE t.tag END AS tag
FROM tokens t LEFT JOIN lexicon l ON l.word = t.word"""


def best_per_run():
    return _runs(SAVED) + """
SELECT run_name, metric, combo_id, weights, train_acc, test_acc, macro_f1 FROM saved WHERE rank = 1"""


def leaderboard():
    return _runs(SAVED) + """
SELECT * FROM (SELECT metric, run_name, combo_id, weights, train_acc, test_acc, macro_f1 FROM saved
               WHERE rank = 1 AND metric = 'accuracy' ORDER BY test_acc DESC, run_name LIMIT 10)
UNION ALL
SELECT * FROM (SELECT metric, run_name, combo_id, weights, train_acc, test_acc, macro_f1 FROM saved
               WHERE rank = 1 AND metric = 'f1' ORDER BY macro_f1 DESC, run_name LIMIT 10)"""


ORACLES = {
    "strip_quotes": _per_doc(C.sql_strip_quotes("{x}")),
    "spaced_commas": _per_doc(C.sql_spaced_commas("{x}")),
    "clean_number_grouped": _per_doc(_rule(P.R_GROUPED_NUMBER, P.NUMBER_TOKEN)),
    "clean_email": _per_doc(_rule(P.R_EMAIL, P.EMAIL_TOKEN)),
    "clean_mention": _per_doc(_rule(P.R_MENTION, P.MENTION_TOKEN)),
    "clean_url": _per_doc(_rule(P.R_URL, P.URL_TOKEN), "pages", "page_id", "url"),
    "clean_number": _per_doc(_rule(P.R_NUMBER, P.NUMBER_TOKEN)),
    "clean_lone_punct": _per_doc(_rule(P.R_LONE_PUNCT, " ")),
    "reduce_lengthening": "SELECT doc_id, " + C.sql_reduce_lengthening("w") +
                          " AS text_out FROM (SELECT doc_id, " + C.sql_normalise_whitespace("text") +
                          " AS w FROM documents)",
    "strip_backslash": _per_doc(C.sql_strip_backslash(C.sql_normalise_whitespace("{x}"))),
    "unicode_repair": f"SELECT conv_id, turn, replace(text, ' the ', {O.q(ESCAPE_SAMPLE[1])}) AS text_out FROM conversations",
    "entity_decode": _per_doc(
        "replace(" + sql_unescape_entities("replace({x}, ' the ', chr(1))") + f", chr(1), {O.q(ENTITY_SAMPLE[1])})",
        "pages", "page_id", "html"),
    "clean_text": _clean_text_sql(),
    "class_distribution": class_distribution(),
    "dedupe_first": "SELECT doc_id, lang, source, n_chars FROM documents "
                    "WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY md5(text))",
    "drop_broken": "SELECT doc_id, n_chars FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(9))",
    "balance_classes": balance_classes(),
    "shuffle_index": shuffle_index(),
    "split_by_position": split_by_position(),
    "row_range": row_range(),
    "union_sources": union_sources(),
    "tag_tokens": tag_tokens(),
    "tag_stats_by_label": tag_stats_by_label(),
    "stopword_filter": stopword_filter(),
    "group_tags": group_tags(),
    "preprocess_docs": preprocess_docs(),
    "vocabulary": vocabulary(),
    "term_counts": term_counts(),
    "binary_bow": binary_bow(),
    "idf": idf(),
    "tfidf": tfidf(),
    "pos_weighted_l1": pos_weighted_l1(),
    "oov_transform": oov_transform(),
    "centroids": centroids(),
    "ocfs_scores": ocfs_scores(),
    "ocfs_keep": ocfs_keep(),
    "top_ocfs_terms": top_ocfs_terms(),
    "ocfs_grid": ocfs_grid(),
    "block_union": block_union(),
    "confusion": confusion(),
    "accuracy": accuracy(),
    "per_class_prf": per_class_prf(),
    "macro_f1": macro_f1(),
    "classification_report": classification_report(),
    "wrong_predictions": wrong_predictions(),
    "weight_grid": weight_grid(),
    "search_runs": search_runs(),
    "run_names": run_names(),
    "model_names": model_names(),
    "beats_threshold": beats_threshold(),
    "top_runs": top_runs(),
    "best_per_run": best_per_run(),
    "leaderboard": leaderboard(),
    "saved_runs": saved_runs(),
    "tag_tokens_lexicon": tag_tokens_lexicon(),
    "ocfs_grid_scale5": ocfs_grid_scale5(),
    "weight_grid_scale5": weight_grid_scale5(),
    "search_runs_scale5": search_runs_scale5(),
    "top_runs_scale5": top_runs_scale5(),
    "leaderboard_scale5": leaderboard_scale5(),
}
