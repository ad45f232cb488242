"""Aggregations: coverage audits, bounds, totals and histograms (A1-A15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, incremental
from ..session import shared_path, stored
from .base import DEFAULTS, HITS_SQL, OVERRIDES, QUOTA_SQL, RULES_SQL, hits, rules
from .registry import load, query

AUDIT_SQL = f"""{RULES_SQL}, {HITS_SQL}, counted AS (
  SELECT rule_id, severity, count(*) FILTER (origin = 'real') AS real, count(*) FILTER (origin = 'synthetic') AS synthetic
  FROM rules LEFT JOIN hits USING (rule_id) GROUP BY ALL
), audit AS (
  SELECT *, real + synthetic AS total, {QUOTA_SQL} AS quota,
         CAST(CASE WHEN {QUOTA_SQL} IS NOT NULL THEN greatest(0, {QUOTA_SQL} - real - synthetic) END AS BIGINT) AS delta FROM counted
)"""


def _audit(spark, d):
    return audit.coverage(rules(spark, d), hits(spark, d), DEFAULTS, OVERRIDES)


@query(f"WITH {HITS_SQL} SELECT rule_id, count(*) FILTER (origin = 'real') AS real, count(*) FILTER (origin = 'synthetic') AS synthetic FROM hits GROUP BY rule_id")
def a1_hits_by_origin(spark, d):
    return audit.hits_by_rule(hits(spark, d))


@query("""SELECT CASE WHEN doc_id % 4 = 0 AND doc_id % 10 <= 7 THEN 'src0' ELSE source END AS source, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN doc_id % 3 = 0 AND doc_id % 10 <= 8 THEN 1 - toxic ELSE toxic END) AS BIGINT) AS hits, CAST(sum(quality) AS BIGINT) AS clean
FROM documents JOIN labels USING (doc_id) WHERE NOT (doc_id % 5 = 0 AND doc_id % 10 <= 6) GROUP BY 1""")
def a1_incremental(spark, d):
    """Rows, hits and clean rows of each source after ten batches of inserts, updates, moves and deletes, one of which comes twice."""
    docs, labels = load(spark, d, "documents", "labels")
    row = docs.select("doc_id", "source").join(labels.select("doc_id", "toxic", "quality"), "doc_id")
    born, id = F.col("doc_id") % 10, F.col("doc_id")
    fields = ["doc_id", "source", "toxic", "quality"]

    def image(source, toxic):
        return F.struct(id.alias("doc_id"), source.alias("source"), toxic.alias("toxic"), F.col("quality"))

    source, toxic = F.col("source"), F.col("toxic")
    turned = F.when(id % 3 == 0, 1 - toxic).otherwise(toxic)
    moved = F.when(id % 4 == 0, F.lit("src0")).otherwise(source)
    none = F.lit(None).cast(row.select(F.struct(*fields).alias("x")).schema["x"].dataType)
    life = [(born, none, image(source, toxic), F.lit(True)), (born + 1, image(source, toxic), image(source, turned), id % 3 == 0), (born + 2, image(source, turned), image(moved, turned), id % 4 == 0), (born + 3, image(moved, turned), none, id % 5 == 0)]
    log = row.select(F.explode(F.array(*[F.struct(batch.cast("int").alias("batch"), before.alias("before"), after.alias("after"), there.alias("there")) for batch, before, after, there in life])).alias("x")).select("x.*").where("there and batch <= 9")
    log = stored(log.drop("there"), "log")
    kept = incremental.Audit(spark, shared_path(spark, "a1"), ["source"], {"hits": lambda r: r["toxic"], "clean": lambda r: r["quality"]})
    for batch in [*range(5), 4, *range(5, 10)]:
        kept.apply(log.where(F.col("batch") == batch), batch)
    return kept.totals()


@query(f"WITH {AUDIT_SQL} SELECT rule_id, severity, real, synthetic, total, quota, delta FROM audit")
def a2_coverage_audit(spark, d):
    return _audit(spark, d)


@query(f"WITH {AUDIT_SQL} SELECT rule_id, quota, delta FROM audit WHERE quota IS NULL OR delta > 0")
def a3_quota_nullable(spark, d):
    return _audit(spark, d).where("quota is null or delta > 0").select("rule_id", "quota", "delta")


@query(f"WITH {AUDIT_SQL} SELECT CAST(sum(real) AS BIGINT) AS real, CAST(sum(synthetic) AS BIGINT) AS synthetic, CAST(sum(total) AS BIGINT) AS total, CASE WHEN NOT bool_or(quota IS NULL) THEN CAST(sum(quota) AS BIGINT) END AS quota, CASE WHEN NOT bool_or(quota IS NULL) THEN CAST(sum(delta) AS BIGINT) END AS delta, count(*) FILTER (total = 0) AS uncovered FROM audit")
def a4_audit_totals(spark, d):
    return audit.totals(_audit(spark, d))


@query("SELECT lang, count(*) AS n, list_sort(list(len))[least(count(*) - 1, floor(count(*) * 0.05))::INT + 1] AS p_low, list_sort(list(len))[least(count(*) - 1, floor(count(*) * 0.95))::INT + 1] AS p_high FROM (SELECT lang, CAST(length(text) AS INT) AS len FROM documents) WHERE len > 0 GROUP BY lang")
def a5_length_bounds(spark, d):
    return audit.percentile_bounds(load(spark, d, "documents").select("lang", F.length("text").alias("len")), ["lang"], "len")


def _probes():
    return {
        "text": F.trim("text") != "",
        "long_text": F.length("text") >= 100,
        "lines": F.contains("text", F.lit("\n")),
        "lang": F.col("lang") != "",
        "n_chars": F.col("n_chars") > 0,
    }


@query("""WITH p AS (SELECT source, count(*) AS n, count(*) FILTER (trim(text) <> '') AS text, count(*) FILTER (length(text) >= 100) AS long_text, count(*) FILTER (contains(text, chr(10))) AS lines, count(*) FILTER (lang <> '') AS lang, count(*) FILTER (n_chars > 0) AS n_chars FROM documents GROUP BY source)
SELECT source, field, filled, CAST(round(filled / n * 100) AS INT) AS pct FROM p UNPIVOT (filled FOR field IN (text, long_text, lines, lang, n_chars))""")
def a6_field_coverage(spark, d):
    return audit.field_coverage(load(spark, d, "documents"), "source", _probes())


@query("SELECT coalesce(source, 'total') AS source, count(*) FILTER (length(text) >= 60) AS passed, count(*) FILTER (length(text) < 60) AS rejected, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (source)")
def a7_source_totals(spark, d):
    docs = load(spark, d, "documents")
    made = docs.rollup("source").agg(F.count_if(F.length("text") >= 60).alias("passed"), F.count_if(F.length("text") < 60).alias("rejected"), F.sum("n_chars").alias("chars"))
    return made.withColumn("source", F.coalesce("source", F.lit("total")))


@query("SELECT source AS rule_id, count(*) AS pending, count(*) FILTER (length(text) >= 500) AS filled, count(*) FILTER (length(text) < 500) AS empty FROM documents ANTI JOIN labels USING (doc_id) GROUP BY source")
def a8_pending_by_rule(spark, d):
    docs, labels = load(spark, d, "documents", "labels")
    pending = docs.join(labels, "doc_id", "left_anti")
    return pending.groupBy(F.col("source").alias("rule_id")).agg(F.count("*").alias("pending"), F.count_if(F.length("text") >= 500).alias("filled"), F.count_if(F.length("text") < 500).alias("empty"))


@query("SELECT event_type, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INT) AS place FROM events GROUP BY event_type")
def a9_histogram(spark, d):
    from pyspark.sql import Window

    counted = load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "event_type")))


@query("SELECT count(*) AS cards, count(toxic) AS labelled, count(*) FILTER (toxic = 0) AS clean, count(*) FILTER (toxic = 1) AS dirty, count(*) FILTER (toxic IS NULL) AS pending FROM documents LEFT JOIN labels USING (doc_id)")
def a10_clean_dirty(spark, d):
    docs, labels = load(spark, d, "documents", "labels")
    return docs.select("doc_id").join(labels, "doc_id", "left").agg(
        F.count("*").alias("cards"), F.count("toxic").alias("labelled"), F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("dirty"), F.count_if(F.col("toxic").isNull()).alias("pending")
    )


@query("SELECT coalesce(CAST(user_id % 5 AS VARCHAR), 'total') AS source, count(*) FILTER (event_type = 'view') AS downloaded, count(*) FILTER (event_type = 'click') AS skipped, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY ROLLUP (user_id % 5)")
def a11_status_counts(spark, d):
    events = load(spark, d, "events").withColumn("source", (F.col("user_id") % 5).cast("string"))
    kinds = {"downloaded": "view", "skipped": "click", "failed": "error"}
    made = events.rollup("source").agg(*[F.count_if(F.col("event_type") == v).alias(k) for k, v in kinds.items()])
    return made.withColumn("source", F.coalesce("source", F.lit("total")))


@query("SELECT coalesce(max(n), 0) + 1 AS next FROM (SELECT CAST(substr(source, 4) AS BIGINT) AS n FROM documents UNION ALL SELECT CAST(substr(s_name, 10) AS BIGINT) FROM supplier UNION ALL SELECT CAST(substr(n_name, 8) AS BIGINT) FROM nation)")
def a12_next_suffix(spark, d):
    docs, supplier, nation = load(spark, d, "documents", "supplier", "nation")
    ids = docs.select(F.col("source").alias("id")).unionByName(supplier.select(F.col("s_name").alias("id"))).unionByName(nation.select(F.col("n_name").alias("id")))
    return audit.next_number(ids, "id", r"(\d+)$")


@query("""WITH t AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS s FROM documents)
SELECT a.doc_id AS a, b.doc_id AS b, CAST(len(a.s) AS INT) AS n_a, CAST(len(b.s) AS INT) AS n_b, CAST(len(list_intersect(a.s, b.s)) AS INT) AS shared,
       round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS jaccard
FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def a13_jaccard_sizes(spark, d):
    t = load(spark, d, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("s"))
    a, b = t.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), t.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    pairs = a.join(b, F.col("b") == F.col("a") + 1).withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return pairs.select("a", "b", F.size("sa").alias("n_a"), F.size("sb").alias("n_b"), "shared", F.round(F.col("shared") / (F.size("sa") + F.size("sb") - F.col("shared")), 6).alias("jaccard"))


@query("""WITH g AS (SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n, count(*) FILTER (l_linenumber = 1) AS covers FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT o_orderstatus AS source, count(*) AS cards, count(*) FILTER (n > 0) AS with_images, CAST(sum(n) AS BIGINT) AS images, CAST(sum(covers) AS BIGINT) AS covers, min(n) FILTER (n > 0) AS least, median(n) FILTER (n > 0) AS median, round(avg(n) FILTER (n > 0), 6) AS mean, max(n) AS most FROM g GROUP BY o_orderstatus""")
def a14_gallery_stats(spark, d):
    orders, lines = load(spark, d, "orders", "lineitem")
    sizes = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linenumber") == 1).alias("covers"))
    g = orders.select("o_orderkey", "o_orderstatus").join(sizes, "o_orderkey", "left").na.fill(0, ["n", "covers"])
    some = F.when(F.col("n") > 0, F.col("n"))
    return g.groupBy(F.col("o_orderstatus").alias("source")).agg(
        F.count("*").alias("cards"), F.count(some).alias("with_images"), F.sum("n").alias("images"), F.sum("covers").alias("covers"), F.min(some).alias("least"), F.median(some).alias("median"), F.round(F.avg(some), 6).alias("mean"), F.max("n").alias("most")
    )


@query(f"""WITH {HITS_SQL}, s AS (SELECT source, count(*) FILTER (toxic = 0) AS clean, count(*) FILTER (toxic = 1) AS dirty, count(*) FILTER (quality = 0 AND toxic = 0) AS review FROM documents JOIN labels USING (doc_id) GROUP BY source),
h AS (SELECT rule_id AS source, string_agg(origin || ' ' || n, ', ' ORDER BY origin) AS hits FROM (SELECT rule_id, origin, count(*) AS n FROM hits GROUP BY ALL) GROUP BY rule_id)
SELECT source, clean, dirty, review, hits FROM s LEFT JOIN h USING (source)""")
def a15_by_source(spark, d):
    docs, labels = load(spark, d, "documents", "labels")
    s = docs.select("doc_id", "source").join(labels, "doc_id").groupBy("source").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("dirty"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("review"))
    n = hits(spark, d).groupBy("rule_id", "origin").agg(F.count("*").alias("n"))
    listed = n.groupBy(F.col("rule_id").alias("source")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("origin", "n"))), lambda x: F.concat_ws(" ", x["origin"], x["n"].cast("string"))), ", ").alias("hits"))
    return s.join(listed, "source", "left")
