"""Evaluation metrics (E1-E15).

There are no provider's answers among the driver's tables. Expected findings are the labelled rules;
predictions are made up from the ids by whole-number formulas, the same in both engines, for three
models and three runs. The figures test the arithmetic and say nothing about any model.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from .base import HITS_SQL, RULES_SQL, SEVERITIES, hits, rules
from .registry import load, query

SETUP = f"""{RULES_SQL}, {HITS_SQL}, m(model, m) AS (VALUES ('a', 1), ('b', 2), ('c', 3)), r(run) AS (VALUES (1), (2), (3)),
every AS (SELECT doc_id, source, model, m, run FROM documents JOIN labels USING (doc_id) CROSS JOIN m CROSS JOIN r),
expected AS (SELECT doc_id, rule_id FROM hits),
predicted AS (SELECT every.doc_id, model, run, source AS rule_id FROM every JOIN labels USING (doc_id) WHERE (toxic = 1 AND (doc_id * 7 + m * 3 + run) % 10 > m) OR (toxic = 0 AND (doc_id * 5 + m * 7 + run) % 40 < m))"""

OUTCOMES = f"""{SETUP}, outcomes AS (SELECT model, run, doc_id, rule_id, CAST(e IS NOT NULL AND p IS NOT NULL AS INT) AS tp, CAST(e IS NULL AS INT) AS fp, CAST(p IS NULL AS INT) AS fn
FROM (SELECT model, run, doc_id, rule_id, 1 AS e FROM expected CROSS JOIN m CROSS JOIN r) FULL JOIN (SELECT model, run, doc_id, rule_id, 1 AS p FROM predicted) USING (model, run, doc_id, rule_id))"""

_SCORES = "CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(sum(tp) / nullif(sum(tp) + sum(fp), 0), 9) AS precision, round(sum(tp) / nullif(sum(tp) + sum(fn), 0), 9) AS recall, round(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 9) AS f1"


def _every(spark, d):
    docs, labels = load(spark, d, "documents", "labels")
    models = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "model string, m int")
    base = docs.select("doc_id", "source").join(labels, "doc_id")
    return base.crossJoin(F.broadcast(models)).withColumn("run", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))


def _predicted(spark, d):
    m, n = F.col("m"), F.col("doc_id")
    hit = (F.col("toxic") == 1) & ((n * 7 + m * 3 + F.col("run")) % 10 > m)
    wrong = (F.col("toxic") == 0) & ((n * 5 + m * 7 + F.col("run")) % 40 < m)
    return _every(spark, d).where(hit | wrong).select("model", "run", "doc_id", F.col("source").alias("rule_id"))


def _expected(spark, d):
    return hits(spark, d).select("doc_id", "rule_id").crossJoin(F.broadcast(spark.createDataFrame([(m, r) for m in "abc" for r in (1, 2, 3)], "model string, run int")))


def _outcomes(spark, d):
    e = _expected(spark, d).withColumn("case", F.struct("model", "run", "doc_id"))
    p = _predicted(spark, d).withColumn("case", F.struct("model", "run", "doc_id"))
    return metrics.outcomes(e, p, "case", "rule_id").select("case.*", "rule_id", "tp", "fp", "fn")


def _rounded(df):
    return df.select(*[F.round(c, 9).alias(c) if c in ("precision", "recall", "f1", "rate", "agreement") else c for c in df.columns])


@query(f"WITH {RULES_SQL}, {HITS_SQL} SELECT doc_id, CASE WHEN bool_or(severity IN ('critical', 'high')) THEN 'reject' WHEN bool_or(severity = 'medium') THEN 'needs_review' ELSE 'approve' END AS verdict FROM documents LEFT JOIN hits USING (doc_id) LEFT JOIN rules USING (rule_id) GROUP BY doc_id")
def e1_verdict(spark, d):
    found = hits(spark, d).join(rules(spark, d), "rule_id").groupBy("doc_id").agg(F.collect_set("severity").alias("s"))
    docs = load(spark, d, "documents").select("doc_id").join(found, "doc_id", "left")
    return docs.select("doc_id", metrics.verdict(F.coalesce("s", F.array().cast("array<string>"))).alias("verdict"))


@query(f"WITH {OUTCOMES} SELECT model, rule_id, {_SCORES} FROM outcomes GROUP BY model, rule_id")
def e2_prf(spark, d):
    return _rounded(metrics.scores(_outcomes(spark, d), "model", "rule_id"))


_BY_RULE = f"{OUTCOMES}, by_rule AS (SELECT model, rule_id, sum(tp) / nullif(sum(tp) + sum(fp), 0) AS precision, sum(tp) / nullif(sum(tp) + sum(fn), 0) AS recall, 2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0) AS f1 FROM outcomes GROUP BY model, rule_id)"


@query(f"WITH {_BY_RULE} SELECT model, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1, count(*) AS rules FROM by_rule GROUP BY model")
def e3_macro(spark, d):
    return _rounded(metrics.macro(metrics.scores(_outcomes(spark, d), "model", "rule_id"), "model"))


@query(f"WITH {OUTCOMES} SELECT model, coalesce(severity, 'all') AS severity, {_SCORES} FROM outcomes JOIN rules USING (rule_id) GROUP BY GROUPING SETS ((model, severity), (model))")
def e4_by_severity(spark, d):
    o = _outcomes(spark, d).join(rules(spark, d), "rule_id")
    whole = metrics.scores(o, "model").withColumn("severity", F.lit("all"))
    return _rounded(metrics.scores(o, "model", "severity").unionByName(whole))


@query("""WITH q AS (SELECT doc_id % 3 AS model, text, CASE WHEN doc_id % 5 = 0 THEN substr(text, 3, 20) || '~' WHEN doc_id % 7 = 0 THEN '' ELSE substr(text, 3, 20) END AS quote FROM documents)
SELECT model, count(*) AS findings, count(*) FILTER (NOT contains(text, quote) OR quote = '') AS false, round(avg(CAST(NOT contains(text, quote) OR quote = '' AS INT)), 9) AS rate FROM q GROUP BY model""")
def e5_hallucination(spark, d):
    n = F.col("doc_id")
    cut = F.substring("text", 3, 20)
    quote = F.when(n % 5 == 0, F.concat(cut, F.lit("~"))).when(n % 7 == 0, F.lit("")).otherwise(cut)
    return _rounded(metrics.hallucination_rate(load(spark, d, "documents").select((n % 3).alias("model"), "text", quote.alias("quote")), "text", "quote", "model"))


_VERDICTS = "CASE x % 3 WHEN 0 THEN 'reject' WHEN 1 THEN 'needs_review' ELSE 'approve' END"


def _verdict_pairs(spark, d):
    v = F.array(F.lit("reject"), F.lit("needs_review"), F.lit("approve"))
    n = F.col("doc_id")
    return load(spark, d, "labels").select((n % 2).alias("model"), F.element_at(v, (n % 3 + 1).cast("int")).alias("expected"), F.element_at(v, ((n * n + F.col("toxic")) % 3 + 1).cast("int")).alias("predicted"))


_PAIRS = f"v AS (SELECT doc_id % 2 AS model, {_VERDICTS.replace('x', 'doc_id')} AS expected, {_VERDICTS.replace('x', '(doc_id * doc_id + toxic)')} AS predicted FROM labels)"


@query(f"WITH {_PAIRS} SELECT model, expected, count(*) FILTER (predicted = 'approve') AS approve, count(*) FILTER (predicted = 'needs_review') AS needs_review, count(*) FILTER (predicted = 'reject') AS reject FROM v GROUP BY model, expected")
def e6_confusion(spark, d):
    return metrics.confusion(_verdict_pairs(spark, d), "expected", "predicted", ["approve", "needs_review", "reject"], "model")


@query(f"WITH {_PAIRS} SELECT model, round(avg(CAST(expected = predicted AS INT)), 9) AS accuracy FROM v GROUP BY model")
def e6_verdict_accuracy(spark, d):
    return _verdict_pairs(spark, d).groupBy("model").agg(F.round(F.avg((F.col("expected") == F.col("predicted")).cast("int")), 9).alias("accuracy"))


@query("SELECT event_type AS model, round(sum(value) / count(DISTINCT user_id) * 1000, 4) AS per_thousand FROM events GROUP BY event_type")
def e7_cost_per_thousand(spark, d):
    return load(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.round(F.sum("value") / F.count_distinct("user_id") * 1000, 4).alias("per_thousand"))


@query("SELECT event_type AS model, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE user_id % 4 <> 0 GROUP BY event_type")
def e8_latency_pctl(spark, d):
    uncached = load(spark, d, "events").where("user_id % 4 <> 0")
    return uncached.groupBy(F.col("event_type").alias("model")).agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("SELECT event_type AS model, round(avg(CAST(json_extract(props, '$.k') AS INT)), 6) AS input_tokens, round(avg(CAST(json_extract(props, '$.k') AS INT) * 2), 6) AS output_tokens FROM events GROUP BY event_type")
def e9_mean_tokens(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.round(F.avg(k), 6).alias("input_tokens"), F.round(F.avg(k * 2), 6).alias("output_tokens"))


@query(f"""WITH {SETUP}, sets AS (SELECT every.model, every.doc_id, every.run, coalesce(string_agg(DISTINCT rule_id, ',' ORDER BY rule_id), '') AS s FROM every LEFT JOIN predicted p ON p.model = every.model AND p.doc_id = every.doc_id AND p.run = every.run GROUP BY ALL)
SELECT model, count(*) AS cases, round(avg(CAST(same AS INT)), 9) AS agreement FROM (SELECT model, doc_id, count(DISTINCT s) = 1 AS same FROM sets GROUP BY model, doc_id) GROUP BY model""")
def e10_agreement(spark, d):
    return _rounded(metrics.agreement(_predicted(spark, d), "doc_id", "run", "rule_id", _every(spark, d).select("model", "doc_id", "run"), "model"))


@query(f"""WITH {_BY_RULE}, f AS (SELECT model, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM by_rule GROUP BY model), t AS (SELECT f.*, CASE model WHEN 'a' THEN 3.0 ELSE 2.0 END::DOUBLE AS cost, CASE model WHEN 'a' THEN 900.0 ELSE 800.0 END::DOUBLE AS p95 FROM f)
SELECT model, round(f1, 9) AS f1, cost, p95, CAST(row_number() OVER (ORDER BY f1 DESC, cost, p95, model) AS INT) AS place FROM t WHERE precision >= 0.4 AND recall >= 0.5""")
def e11_gates(spark, d):
    f = metrics.macro(metrics.scores(_outcomes(spark, d), "model", "rule_id"), "model")
    models = f.withColumn("cost", F.when(F.col("model") == "a", F.lit(3.0)).otherwise(F.lit(2.0))).withColumn("p95", F.when(F.col("model") == "a", F.lit(900.0)).otherwise(F.lit(800.0)))
    return metrics.gates(models, {"precision": 0.4, "recall": 0.5}).select("model", F.round("f1", 9).alias("f1"), "cost", "p95", "place")


@query(f"WITH {SETUP}, n AS (SELECT doc_id, count(*) FILTER (model = 'a') AS one, count(*) FILTER (model = 'b') AS two FROM predicted GROUP BY doc_id) SELECT CAST(two - one AS BIGINT) AS difference, count(*) AS cases FROM n GROUP BY 1")
def e12_paired(spark, d):
    n = _predicted(spark, d).groupBy("doc_id").agg(F.count_if(F.col("model") == "a").alias("one"), F.count_if(F.col("model") == "b").alias("two"))
    return n.groupBy((F.col("two") - F.col("one")).alias("difference")).agg(F.count("*").alias("cases"))


@query("SELECT event_type AS model, round(avg(CAST(json_valid(CASE WHEN event_id % 6 = 0 THEN substr(props, 1, 4) ELSE props END) AS INT)), 9) AS valid FROM events GROUP BY event_type")
def e13_json_validity(spark, d):
    answer = F.when(F.col("event_id") % 6 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    return load(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.round(F.avg(F.try_parse_json(answer).isNotNull().cast("int")), 9).alias("valid"))


@query(f"""WITH {SETUP}, s AS (SELECT doc_id, list_sort(list(DISTINCT rule_id)) AS found FROM predicted WHERE model = 'c' GROUP BY doc_id)
SELECT doc_id, rule_id AS target, found IS NOT NULL AND list_contains(found, rule_id) AS hit, found IS NOT NULL AND found = [rule_id] AS exact FROM expected LEFT JOIN s USING (doc_id)""")
def e14_blind(spark, d):
    s = _predicted(spark, d).where("model = 'c'").groupBy("doc_id").agg(F.array_sort(F.collect_set("rule_id")).alias("found"))
    e = hits(spark, d).select("doc_id", F.col("rule_id").alias("target")).join(s, "doc_id", "left")
    return e.select("doc_id", "target", F.coalesce(F.array_contains("found", F.col("target")), F.lit(False)).alias("hit"), F.coalesce(F.col("found") == F.array("target"), F.lit(False)).alias("exact"))


@query(f"WITH {_BY_RULE}, f AS (SELECT model, avg(f1) AS f1 FROM by_rule GROUP BY model) SELECT x.model AS one, y.model AS two, round(y.f1 - x.f1, 9) AS difference, abs(y.f1 - x.f1) >= 0.05 AS clear FROM f x JOIN f y ON x.model < y.model")
def e15_clear_difference(spark, d):
    f = metrics.macro(metrics.scores(_outcomes(spark, d), "model", "rule_id"), "model").select("model", "f1")
    x, y = f.select(F.col("model").alias("one"), F.col("f1").alias("f")), f.select(F.col("model").alias("two"), F.col("f1").alias("g"))
    return x.join(y, F.col("one") < F.col("two")).select("one", "two", F.round(F.col("g") - F.col("f"), 9).alias("difference"), (F.abs(F.col("g") - F.col("f")) >= 0.05).alias("clear"))
