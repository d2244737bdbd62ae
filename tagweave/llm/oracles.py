"""DuckDB SQL of the queries of this subpackage that SQL can express.

The statements say what the result is, not how the operators find it: near-duplicates by
counting shared shingles of every pair, quality measures by unnesting words and lines, nearest
centroids by measuring all of them, divergences over the full grid of groups and terms.
"""

from __future__ import annotations

from tagweave.llm import quality as Q

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS ws FROM documents
),
starts AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM split WHERE len(ws) > 0
),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:least(i + 3, len(ws))], ' ') AS s FROM starts
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * same >= 80 * (x.n + y.n - same)
),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, b AS other FROM edges
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
),
least_of AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.other, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(l.other, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN least_of l ON l.doc_id = d.doc_id"""


def quality_rules() -> str:
    """Counts, fences and verdicts of the quality query (ids are unique in the tables)."""
    gamma = f"{Q.GAMMA!r}::DOUBLE"
    bucket = f"CASE WHEN value > 0 THEN ceil(ln(value) / ln({gamma})) ELSE {Q.ZERO_BUCKET} END"
    value = lambda b: f"CASE WHEN {b} = {Q.ZERO_BUCKET} THEN 0 ELSE 2 * pow({gamma}, {b}) / ({gamma} + 1) END"
    each = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS value FROM measured WHERE NOT base_failed"
                          for m in (*Q.MEASURES, *Q.SIZES))
    at = {f"q{round(100 * q)}": q for q in sorted({0.5, *[q for level, *_ in Q.MEASURES.values() for q in (level, round(1 - level, 9))]})}
    quantiles = ", ".join(f"min(CASE WHEN upto >= {q}::DOUBLE * total THEN bucket END) AS {name}" for name, q in at.items())
    levels = []
    for level, by in enumerate((["lang", "source"], ["lang"], [])):
        keys = ", ".join([*by, "measure"])
        same = " AND ".join(["p.measure = f.measure", *[f"p.{c} IS NOT DISTINCT FROM f.{c}" for c in by]])
        enough = f"f.total >= {Q.MIN_GROUP}" if by else "TRUE"
        levels.append(f"""
SELECT p.lang, p.source, p.measure, {level} AS level, {', '.join(f'f.{name}' for name in at)} FROM pairs p JOIN (
  SELECT {keys}, max(total) AS total, {quantiles}
  FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}) AS total,
               sum(n) OVER (PARTITION BY {keys} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto
        FROM (SELECT {keys}, bucket, sum(n) AS n FROM sketch GROUP BY {keys}, bucket)) GROUP BY {keys}) f
ON {same} WHERE {enough}""")
    outside = []
    for m, (level, widths, both, size, hits) in Q.MEASURES.items():
        low, high = value(f"f.q{round(100 * (1 - level))}"), value(f"f.q{round(100 * level)}")
        spread = f"{widths}::DOUBLE * (({high}) - ({low}))"
        fence = f"({high}) * {gamma} + {spread}"
        if size:
            fence = f"greatest({fence}, {hits}::DOUBLE / ({value('s.q50')}))"
        low_end = f" OR m.{m} < ({low}) / {gamma} - {spread}" if both else ""
        outside.append(f"(f.measure = '{m}' AND s.measure = '{size or m}' AND (m.{m} > {fence}{low_end}))")
    return rf"""
WITH split AS MATERIALIZED (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM documents
),
windows AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM split WHERE len(ws) > 2)
),
repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1
),
covered AS (
  SELECT doc_id, sum(least(3, step)) AS n
  FROM (SELECT doc_id, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 3) AS step FROM repeated) GROUP BY doc_id
),
counted AS (
  SELECT s.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(coalesce(array_to_string(ws, ''), ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN covered c ON c.doc_id = s.doc_id
),
measured AS MATERIALIZED (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN word_chars / n_words::DOUBLE END AS mean_word,
         CASE WHEN n_words > 0 THEN n_symbols / word_chars::DOUBLE END AS symbol_share,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines::DOUBLE END AS dup_line_share,
         CASE WHEN n_words > 0 THEN n_repeat_words / n_words::DOUBLE END AS repeat_share
  FROM counted
),
sketch AS MATERIALIZED (
  SELECT lang, source, measure, bucket, count(*) AS n
  FROM (SELECT lang, source, measure, {bucket} AS bucket FROM ({each}) WHERE value IS NOT NULL) GROUP BY 1, 2, 3, 4
),
pairs AS MATERIALIZED (SELECT DISTINCT lang, source, measure FROM sketch),
levels AS ({' UNION ALL '.join(levels)}),
fences AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, measure ORDER BY level) AS r FROM levels) WHERE r = 1
),
outside AS (
  SELECT DISTINCT m.doc_id FROM measured m JOIN fences f
  ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
  JOIN fences s ON s.lang IS NOT DISTINCT FROM f.lang AND s.source IS NOT DISTINCT FROM f.source
  WHERE {' OR '.join(outside)}
)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND o.doc_id IS NULL AS kept
FROM measured m LEFT JOIN outside o ON o.doc_id = m.doc_id"""


def centroid_clusters(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> str:
    """Assignments after ``rounds`` rounds; every distance is measured."""
    def assigned(step: int) -> str:
        return f"""
far{step} AS MATERIALIZED (
  SELECT x.row, x.vec_id, x.v, c.cluster,
         list_sum(list_transform(range(1, {dim} + 1), lambda i: (x.v[i] - c.c[i]) * (x.v[i] - c.c[i])))::BIGINT AS distance
  FROM kept x CROSS JOIN centroid{step} c
),
assigned{step} AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY distance, cluster) AS r FROM far{step}) WHERE r = 1
)"""

    steps = []
    for step in range(rounds):
        steps.append(f"""{assigned(step)},
sums{step} AS (
  SELECT cluster, i, sum(v[i])::HUGEINT AS total, count(*)::HUGEINT AS n
  FROM (SELECT cluster, v, unnest(range(1, {dim} + 1)) AS i FROM assigned{step}) GROUP BY cluster, i
),
moved{step} AS (
  SELECT cluster, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM sums{step} GROUP BY cluster
),
centroid{step + 1} AS MATERIALIZED (
  SELECT o.cluster, coalesce(m.c, o.c) AS c FROM centroid{step} o LEFT JOIN moved{step} m ON m.cluster = o.cluster
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}
),
centroid0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1)::INTEGER AS cluster, v AS c
  FROM kept WHERE vec_id IS NOT NULL QUALIFY cluster < {k}
),{",".join(steps)},{assigned(rounds)}
SELECT vec_id, a.cluster, distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM assigned{rounds} a JOIN centroid{rounds} c ON c.cluster = a.cluster"""


TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

SOURCE_DIVERGENCE = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({LOWER}, '{TERM}') AS ts FROM documents
),
used AS MATERIALIZED (SELECT row, lang, source, unnest(ts) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term FROM used GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
counts AS MATERIALIZED (
  SELECT u.lang, u.source, u.term, count(*) AS n FROM used u JOIN kept k ON k.lang = u.lang AND k.term = u.term GROUP BY 1, 2, 3
),
in_lang AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM counts GROUP BY 1, 2),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
terms AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
whole AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0)
         + 5 * coalesce((SELECT v FROM terms t WHERE t.lang = g.lang), 0) AS d FROM groups g
),
whole_lang AS MATERIALIZED (SELECT lang, sum(n) + 5 * count(*) AS d FROM in_lang GROUP BY lang),
grid AS MATERIALIZED (
  SELECT w.lang, w.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // w.d AS p
  FROM whole w JOIN kept k ON k.lang = w.lang
  LEFT JOIN counts c ON c.lang = w.lang AND c.source = w.source AND c.term = k.term
),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT g.lang, g.source, 'term', g.term, (g.p - q)::BIGINT
  FROM grid g JOIN (SELECT i.lang, i.term, 1 + (1000000000::HUGEINT * (i.n + 5)) // w.d AS q
                    FROM in_lang i JOIN whole_lang w ON w.lang = i.lang) l ON l.lang = g.lang AND l.term = g.term
  WHERE g.n > 0 AND g.p > q
)
SELECT * FROM (
  SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM found
) WHERE part = 'pair' OR rank <= 50"""


ORACLES = {"op6_quality_rules": quality_rules(), "op9_near_dedup": NEAR_DUPLICATES,
           "op12_centroid_clusters": centroid_clusters(), "op13_source_divergence": SOURCE_DIVERGENCE}
