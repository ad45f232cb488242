"""Joins and set membership (J1-J15), near-duplicates (V10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from .base import HITS_SQL, RULES_SQL, hits, rules
from .registry import load, query


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def j1_pending(spark, d):
    docs, labels = load(spark, d, "documents", "labels")
    return joins.pending(docs.select("doc_id", "source"), labels, "doc_id")


@query("SELECT doc_id FROM documents LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN toxic = 0 END AS flag FROM labels) USING (doc_id) WHERE doc_id % 4 > 0 AND flag IS NULL")
def j2_pending_images(spark, d):
    docs, labels = load(spark, d, "documents", "labels")
    flags = labels.select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("toxic") == 0).alias("flag"))
    return joins.pending_images(docs.select("doc_id"), flags, "doc_id", F.col("doc_id") % 4, "flag")


@query("SELECT doc_id, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'de')")
def j3_orphans(spark, d):
    docs, labels = load(spark, d, "documents", "labels")
    return joins.orphans(labels.select("doc_id", "toxic"), docs.where("lang <> 'de'"), "doc_id")


@query("SELECT doc_id, source, lang, quality = 1 AS expected_clean, toxic FROM documents JOIN labels USING (doc_id)")
def j4_case_join(spark, d):
    docs, labels = load(spark, d, "documents", "labels")
    return docs.join(labels, "doc_id").select("doc_id", "source", "lang", (F.col("quality") == 1).alias("expected_clean"), "toxic")


@query(f"WITH {RULES_SQL}, {HITS_SQL} SELECT rule_id, severity, count(doc_id) AS hits FROM rules LEFT JOIN hits USING (rule_id) GROUP BY ALL")
def j5_rules_left_hits(spark, d):
    counted = hits(spark, d).groupBy("rule_id").agg(F.count("*").alias("hits"))
    return rules(spark, d).join(counted, "rule_id", "left").na.fill(0, ["hits"])


@query(f"WITH {HITS_SQL} SELECT doc_id, rule_id, 'unknown key' AS error FROM hits WHERE rule_id NOT IN (SELECT DISTINCT source FROM documents WHERE CAST(substr(source, 4) AS INT) < 15)")
def j6_unknown_rules(spark, d):
    known = rules(spark, d).where("cast(substring(rule_id, 4, 9) as int) < 15")
    return joins.key_errors(hits(spark, d).select("doc_id", "rule_id"), known, "rule_id")


@query(f"""WITH {RULES_SQL}, {HITS_SQL}, v AS (SELECT doc_id, rule_id, list_extract(['critical', 'high', 'medium', 'low'], CAST(doc_id % 4 AS INT) + 1) AS severity FROM hits)
SELECT doc_id, rule_id, v.severity, CASE WHEN r.severity IS NULL THEN 'unknown key' ELSE 'attribute differs' END AS error
FROM v LEFT JOIN (SELECT * FROM rules WHERE rule_id <> 'src1') r USING (rule_id) WHERE r.severity IS NULL OR r.severity <> v.severity""")
def j7_severity_mismatch(spark, d):
    from .base import SEVERITIES

    v = hits(spark, d).select("doc_id", "rule_id", F.element_at(F.array(*map(F.lit, SEVERITIES)), (F.col("doc_id") % 4 + 1).cast("int")).alias("severity"))
    return joins.key_errors(v, rules(spark, d).where("rule_id <> 'src1'"), "rule_id", "severity")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN (SELECT l_orderkey, list(l_partkey) AS parts FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey) USING (l_orderkey) WHERE l_linenumber > 3 AND NOT list_contains(parts, l_partkey)")
def j8_array_membership(spark, d):
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    images = lines.where("l_linenumber <= 3").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    return lines.where("l_linenumber > 3").join(images, "l_orderkey").where(~F.array_contains("parts", F.col("l_partkey"))).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"WITH {RULES_SQL}, scope AS (SELECT DISTINCT 'src' || CAST(n_nationkey AS VARCHAR) AS rule_id FROM nation) SELECT rule_id, 'in scope' AS status FROM rules SEMI JOIN scope USING (rule_id) UNION ALL SELECT rule_id, 'unknown' FROM scope ANTI JOIN rules USING (rule_id)")
def j9_scope(spark, d):
    r = rules(spark, d)
    scope = load(spark, d, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("rule_id")).distinct()
    known = joins.in_scope(r, scope, "rule_id").select("rule_id", F.lit("in scope").alias("status"))
    return known.unionByName(joins.unknown_scope(r, scope, "rule_id").select("rule_id", F.lit("unknown").alias("status")))


MODELS = ("lite", "pro", "pro-max", "pro-max:1.0", "other")
PRICES = {"lite": 0.2, "pro": 1.5, "pro-max": 1.95}
MODEL_SQL = "list_extract(['lite', 'pro', 'pro-max', 'pro-max:1.0', 'other'], CAST(user_id % 5 AS INT) + 1)"
CALLS_SQL = f"calls AS (SELECT event_id, user_id, event_type, value, ts, {MODEL_SQL} AS model, CAST(json_extract(props, '$.k') AS INT) AS tokens FROM events)"
PRICES_SQL = "prices(price_key, rate) AS (VALUES ('lite', 0.2::DOUBLE), ('pro', 1.5::DOUBLE), ('pro-max', 1.95::DOUBLE))"
PRICED_SQL = f"{CALLS_SQL}, {PRICES_SQL}, best AS (SELECT model, max_by(price_key, length(price_key)) AS price_key FROM (SELECT DISTINCT model FROM calls) JOIN prices ON model = price_key OR starts_with(model, price_key || '-') OR starts_with(model, price_key || ':') GROUP BY model), priced AS (SELECT calls.*, best.price_key, rate FROM calls LEFT JOIN best USING (model) LEFT JOIN prices USING (price_key))"


def calls(spark, d):
    e = load(spark, d, "events")
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("user_id") % 5 + 1).cast("int"))
    return e.select("event_id", "user_id", "event_type", "value", "ts", model.alias("model"), F.get_json_object("props", "$.k").cast("int").alias("tokens"))


def prices(spark):
    return spark.createDataFrame(list(PRICES.items()), "price_key string, rate double")


@query(f"WITH {PRICED_SQL} SELECT event_id, model, price_key, rate FROM priced")
def j10_longest_prefix(spark, d):
    return joins.longest_prefix(calls(spark, d).select("event_id", "model"), prices(spark), "model", "price_key")


@query("""WITH s(site) AS (VALUES ('src1'), ('src1_2'), ('src2'), ('src7')), ids AS (SELECT doc_id, source || '_' || doc_id AS case_id FROM documents)
SELECT doc_id, case_id, min(site) AS site FROM ids LEFT JOIN s ON starts_with(case_id, site || '_') GROUP BY doc_id, case_id""")
def j11_source_of(spark, d):
    ids = load(spark, d, "documents").select("doc_id", F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("case_id"))
    sites = spark.createDataFrame([(s,) for s in ("src1", "src1_2", "src2", "src7")], "site string")
    return joins.source_of(ids, "case_id", sites, "site")


_SHINGLES = r"""s AS (SELECT id, len(t) AS words, CASE WHEN len(t) >= 5 THEN list_distinct([array_to_string(t[i:i + 4], ' ') FOR i IN range(1, len(t) - 3)]) ELSE [] END AS s
FROM (SELECT id, [x FOR x IN regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}\s]+', ' ', 'g'), '\s+') IF x <> ''] AS t FROM src)), g AS (SELECT id, len(s) AS n, unnest(s) AS g FROM s)"""


@query(f"""WITH src AS (SELECT doc_id AS id, text FROM documents), {_SHINGLES}
SELECT a.id AS a, b.id AS b, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 9) AS similarity FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) > 0.7""")
def j12_near_dup(spark, d):
    return joins.near_duplicates(load(spark, d, "documents"), "doc_id", "text").select("a", "b", F.round("similarity", 9).alias("similarity"))


@query(f"""WITH src AS (SELECT doc_id AS id, text FROM documents), {_SHINGLES}, pairs AS (
  SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) > 0.7
), classes AS (SELECT id, CASE WHEN len(s) > 0 THEN min(id) OVER (PARTITION BY list_sort(s)) END AS class FROM s)
SELECT id AS doc_id, class, count(b) AS links FROM classes LEFT JOIN pairs ON a = id GROUP BY id, class""")
def j12_near_dup_links(spark, d):
    """Each document's class of equal shingle sets and number of near-duplicates, without a pair of copies being made."""
    return joins.near_duplicate_links(load(spark, d, "documents"), "doc_id", "text")


@query(f"""WITH src AS (SELECT -1 - item_id AS id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents), {_SHINGLES}
SELECT a.id AS a, -1 - b.id AS b, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 9) AS similarity FROM g a JOIN g b ON a.g = b.g AND a.id >= 0 AND b.id < 0 GROUP BY a.id, b.id HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) > 0.1""")
def v10_benchmark_overlap(spark, d):
    docs, items = load(spark, d, "documents", "benchmark")
    return joins.near_duplicates(docs.select("doc_id", "text"), "doc_id", "text", above=0.1, other=items.select(F.col("item_id").alias("doc_id"), "text")).select("a", "b", F.round("similarity", 9).alias("similarity"))


PATTERNS = {"shout": "!!", "license": r"[Ll]icensed\s+under", "token": r"token\s*=", "percent": r"[0-9]+\s*%"}


@query(r"""WITH p(pattern, re) AS (VALUES ('shout', '!!'), ('license', '[Ll]icensed\s+under'), ('token', 'token\s*='), ('percent', '[0-9]+\s*%'))
SELECT doc_id, pattern, regexp_extract(text, re) AS match FROM documents CROSS JOIN p WHERE regexp_extract(text, re) <> ''""")
def j13_pattern_hits(spark, d):
    return joins.pattern_hits(load(spark, d, "documents").select("doc_id", "text"), "text", PATTERNS)


@query("SELECT e.event_id, e.user_id, 'no text row' AS error FROM events e WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.user_id)")
def j14_precondition(spark, d):
    events, labels = load(spark, d, "events", "labels")
    images = events.where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("doc_id"))
    return joins.key_errors(images, labels, "doc_id").select("event_id", F.col("doc_id").alias("user_id"), F.lit("no text row").alias("error"))


@query("SELECT l_orderkey, list_sort(list(DISTINCT l_partkey)) AS missing FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40) GROUP BY l_orderkey")
def j15_missing_parts(spark, d):
    lines, part = load(spark, d, "lineitem", "part")
    cards = lines.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return joins.missing_parts(cards, "l_orderkey", "parts", part.where("p_size < 40").select(F.col("p_partkey").alias("part")), "part")
