"""DuckDB SQL for the queries that SQL can express.

op2 and op9 fit models, op5, op7 and op12 need a vocabulary file, op8 bootstraps patterns, op10 parses
HTML, and the pipeline holds all of these: their tests compare them with brute-force versions or
held-out rows instead.
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1 = """
WITH v AS (
  SELECT DISTINCT vec_id, [floor(64 * CAST(x AS DOUBLE))::BIGINT FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY rank <= 20
"""

OP3 = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents
), starts AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)
), least AS (
  SELECT win, min(doc_id) AS first FROM starts GROUP BY win
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM starts JOIN least USING (win) WHERE first < doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP4 = rf"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("text")}, {_ALNUM}) AS w FROM benchmark WHERE text IS NOT NULL
), wins AS (
  SELECT DISTINCT item, 13 AS n, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - 11)) AS i FROM items WHERE len(w) >= 13)
  UNION
  SELECT DISTINCT item, len(w), array_to_string(w, ' ') FROM items WHERE len(w) BETWEEN 1 AND 12
), d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALNUM}) AS w FROM documents
), found AS (
  SELECT doc_id, i, n, item
  FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
              FROM d CROSS JOIN (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)) JOIN wins USING (n, win)
), hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id
), met AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN met USING (doc_id)
"""

OP6 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_SPACED}) AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS m FROM reach GROUP BY a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM sets LEFT JOIN least ON doc_id = a
"""

_TERM = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"
_P = "1 + (1000000000::HUGEINT * ({} + 2)) // ({} + 2 * {})"
_F = "(({0}) - ({1})) * (({0}) - ({1})) // (({0}) + ({1}))"

OP11 = rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_TERM}) AS w FROM documents
), groups AS (
  SELECT DISTINCT lang, source FROM d
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 10
), found AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN found f USING (lang, source, term)
), per AS (
  SELECT lang, source, term, n, {_P.format("n", "sum(n) OVER (PARTITION BY lang, source)", "v")} AS p FROM dense JOIN sizes USING (lang)
), whole AS (
  SELECT lang, term, {_P.format("n", "sum(n) OVER (PARTITION BY lang)", "v")} AS q
  FROM (SELECT lang, term, sum(n) AS n FROM found GROUP BY lang, term) JOIN sizes USING (lang)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum({_F.format("x.p", "y.p")}) AS value
    FROM per x JOIN per y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
), tops AS (
  SELECT lang, source, 'term' AS part, term AS item, {_F.format("p", "q")} AS value FROM per JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

ORACLES: dict[str, str] = {
    "op1_topk_search": OP1,
    "op3_substring_dedup": OP3,
    "op4_decontamination": OP4,
    "op6_near_duplicates": OP6,
    "op11_source_divergence": OP11,
}
