"""Windows, samples and limits (W1-W7, Q1-Q6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, sampling, scans
from .audit import AUDIT_SQL, _audit
from .registry import load, query

MIX = "(doc_id * 7919 + 42) % 10007"


def _mix():
    return (F.col("doc_id") * 7919 + 42) % 10007


@query(f"WITH {AUDIT_SQL} SELECT rule_id, delta, take FROM (SELECT rule_id, delta, CAST(greatest(0, least(delta, 20 - coalesce(sum(delta) OVER (ORDER BY delta DESC, rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS take FROM audit WHERE delta > 0) WHERE take > 0")
def w1_alloc(spark, d):
    return audit.allocate(_audit(spark, d), 20)


@query(f"SELECT doc_id, CAST((row_number() OVER (ORDER BY {MIX}, doc_id) - 1) % 12 AS INT) AS slot FROM documents")
def w2_round_robin(spark, d):
    plan = load(spark, d, "documents").select("doc_id")
    return sampling.round_robin(plan, [str(i) for i in range(12)], [_mix(), "doc_id"]).select("doc_id", F.col("topic").cast("int").alias("slot"))


@query("SELECT doc_id, 'synth_' || source || '_' || CASE WHEN n < 100 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS case_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) + 3 AS n FROM documents)")
def w3_ids(spark, d):
    from ..functions.text import known_id

    rows = load(spark, d, "documents").select("doc_id", "source")
    return sampling.numbered(rows, "source", F.lit(3), ["doc_id"]).select("doc_id", known_id(F.col("source"), F.col("number")).alias("case_id"))


@query("SELECT user_id, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INT) AS place FROM events QUALIFY place <= 3")
def w4_topk(spark, d):
    return sampling.top_k(load(spark, d, "events").select("user_id", "event_id", "value"), "user_id", [F.col("value").desc(), "event_id"], 3)


@query("SELECT doc_id, CAST(i - 1 AS INT) AS at, word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))")
def w5_positions(spark, d):
    return load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "word"))


@query("SELECT conv_id, turn, CAST(sum(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM conversations")
def w6_segments(spark, d):
    return scans.segments(load(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn"], F.col("role") == "user").select("conv_id", "turn", "segment")


@query("""WITH s AS (SELECT *, greatest(1, sum(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS segment FROM conversations)
SELECT conv_id, CAST(segment AS BIGINT) AS segment, left(max(text) FILTER (role = 'user'), 120) AS title, left(coalesce(string_agg(text, ' | ' ORDER BY turn) FILTER (role <> 'user' AND length(text) >= 3), ''), 4000) AS body
FROM s GROUP BY conv_id, segment HAVING count(*) FILTER (role = 'user') > 0""")
def w6_segment_texts(spark, d):
    """Turns of a user with what follows them, as titles and bodies."""
    return scans.segment_texts(load(spark, d, "conversations"), "conv_id", "turn", F.col("text"), F.col("role") == "user")


@query("""SELECT event_id, sum(value) OVER w AS spent, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS purchase
FROM (SELECT event_id, event_type, user_id, ts, CAST(floor(value) AS BIGINT) AS value FROM events) WINDOW w AS (PARTITION BY user_id % 5 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def w6_running(spark, d):
    """Running sum and last purchase of five owners of all events."""
    events = load(spark, d, "events").select("event_id", "ts", "event_type", (F.col("user_id") % 5).alias("owner"), F.floor("value").alias("value"))
    values = {"spent": scans.Running("sum", F.col("value")), "purchase": scans.Running("last", F.when(F.col("event_type") == "purchase", F.col("event_id")))}
    return scans.scan(events, "owner", ["ts", "event_id"], values).select("event_id", "spent", "purchase")


@query(f"SELECT doc_id, source, first FROM (SELECT doc_id, source, {MIX} AS m, row_number() OVER (PARTITION BY source ORDER BY {MIX}, doc_id) <= 2 AS first FROM documents) QUALIFY row_number() OVER (ORDER BY first DESC, m, doc_id) <= 60")
def w7_min_then_fill(spark, d):
    return sampling.least_per_stratum(load(spark, d, "documents").select("doc_id", "source"), "source", 2, 60, [_mix(), "doc_id"])


@query(f"SELECT doc_id, source FROM documents ORDER BY {MIX}, doc_id LIMIT 22")
def q1_seeded_sample(spark, d):
    return sampling.sample(load(spark, d, "documents").select("doc_id", "source"), [_mix(), "doc_id"], 22)


@query(f"SELECT doc_id, bucket, CAST(place AS INT) AS place FROM (SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'rest' END AS bucket, row_number() OVER (PARTITION BY CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'rest' END ORDER BY {MIX}, doc_id) AS place FROM documents) WHERE place <= CASE bucket WHEN 'en' THEN 24 WHEN 'fr' THEN 15 ELSE 21 END")
def q2_stratified(spark, d):
    return sampling.stratified(load(spark, d, "documents").select("doc_id", "lang"), "lang", {"en": 0.4, "fr": 0.25}, 60, [_mix(), "doc_id"]).select("doc_id", "bucket", "place")


@query(f"SELECT doc_id, lang, first FROM (SELECT doc_id, lang, {MIX} AS m, row_number() OVER (PARTITION BY lang ORDER BY {MIX}, doc_id) <= 5 AS first FROM documents) QUALIFY row_number() OVER (ORDER BY first DESC, m, doc_id) <= 30")
def q3_min_per_stratum(spark, d):
    return sampling.least_per_stratum(load(spark, d, "documents").select("doc_id", "lang"), "lang", 5, 30, [_mix(), "doc_id"])


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 7")
def q4_ordered(spark, d):
    return load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "source").limit(7)


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id) WHERE lang = 'en' ORDER BY doc_id LIMIT 40")
def q5_limit_attempted(spark, d):
    docs, labels = load(spark, d, "documents", "labels")
    return docs.where("lang = 'en'").select("doc_id").join(labels, "doc_id", "left_anti").orderBy("doc_id").limit(40)


@query("SELECT doc_id, source FROM documents WHERE source = 'src2' ORDER BY doc_id LIMIT 5")
def q6_candidates(spark, d):
    return load(spark, d, "documents").where("source = 'src2'").select("doc_id", "source").orderBy("doc_id").limit(5)
