"""Extensions (x_*): deterministic text features behind some rules, and windows and joins over the star tables.

Their thresholds are this engine's own; nothing else claims them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import load, query


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+')) AS emails, len(regexp_extract_all(text, '\+[0-9][0-9() .-]{7,}[0-9]')) AS phones, len(regexp_extract_all(text, 'https?://[^\s]+')) AS links FROM documents")
def x_pii_scan(spark, d):
    def n(pattern):
        return F.size(F.regexp_extract_all("text", F.lit(f"({pattern})"))).cast("long")

    return load(spark, d, "documents").select("doc_id", n(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+").alias("emails"), n(r"\+[0-9][0-9() .-]{7,}[0-9]").alias("phones"), n(r"https?://[^\s]+").alias("links"))


@query("SELECT doc_id, round(length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(length(regexp_replace(text, '[^A-Za-z]', '', 'g')), 1), 6) AS caps, length(regexp_replace(text, '[^!]', '', 'g')) AS exclamations FROM documents")
def x_caps_pressure(spark, d):
    caps = F.length(F.regexp_replace("text", "[^A-Z]", "")) / F.greatest(F.length(F.regexp_replace("text", "[^A-Za-z]", "")), F.lit(1))
    return load(spark, d, "documents").select("doc_id", F.round(caps, 6).alias("caps"), F.length(F.regexp_replace("text", "[^!]", "")).cast("long").alias("exclamations"))


@query("SELECT doc_id, length(trim(text)) < 60 AS short, regexp_matches(text, '(?i)lorem ipsum|<[a-z]+>|todo') AS junk FROM documents")
def x_placeholder_text(spark, d):
    return load(spark, d, "documents").select("doc_id", (F.length(F.trim("text")) < 60).alias("short"), F.rlike("text", F.lit("(?i)lorem ipsum|<[a-z]+>|todo")).alias("junk"))


@query("SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 10 GROUP BY ALL HAVING count(*) >= 3")
def x_slogan_repetition(spark, d):
    lines = load(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= 10)
    return lines.groupBy("doc_id", "line").agg(F.count("*").alias("n")).where("n >= 3")


#: Blocks of pictographs, as classes of a pattern.
EMOJI = r"[\x{2600}-\x{27BF}\x{1F300}-\x{1FAFF}]"


@query(r"SELECT doc_id, emoji, round(emoji / greatest(length(text), 1), 6) AS density, emoji >= 3 AND emoji > 0.02 * length(text) AS dense FROM (SELECT doc_id, t AS text, CAST(length(regexp_replace(t, '[^\x{2600}-\x{27BF}\x{1F300}-\x{1FAFF}]', '', 'g')) AS BIGINT) AS emoji FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || repeat('🎉🔥✨🎉', (length(text) // 200 + 1)::INT) ELSE text END AS t FROM documents))")
def x_emoji_density(spark, d):
    # the tables have no pictographs: every tenth text gets some
    text = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.repeat(F.lit("🎉🔥✨🎉"), F.floor(F.length("text") / 200).cast("int") + 1))).otherwise(F.col("text"))
    n = F.length(F.regexp_replace("text", EMOJI.replace("[", "[^", 1), "")).cast("long")
    counted = load(spark, d, "documents").select("doc_id", text.alias("text")).withColumn("emoji", n)
    return counted.select("doc_id", "emoji", F.round(F.col("emoji") / F.greatest(F.length("text"), F.lit(1)), 6).alias("density"), ((F.col("emoji") >= 3) & (F.col("emoji") > 0.02 * F.length("text"))).alias("dense"))


#: Letters of a language besides a to z.
LETTERS = {"en": "", "de": "äöüß", "fr": "àâæçéèêëîïôœùûüÿ", "es": "áéíñóúü"}


@query(r"""SELECT doc_id, letters, strange, strange > 0.02 * letters AS mismatch FROM (SELECT doc_id, CAST(length(l) AS BIGINT) AS letters, CAST(length(translate(l, 'abcdefghijklmnopqrstuvwxyz' || CASE said WHEN 'de' THEN 'äöüß' WHEN 'fr' THEN 'àâæçéèêëîïôœùûüÿ' WHEN 'es' THEN 'áéíñóúü' ELSE '' END, '')) AS BIGINT) AS strange
FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'en' ELSE lang END AS said, regexp_replace(lower(text), '[^\p{L}]', '', 'g') AS l FROM documents))""")
def x_language_mismatch(spark, d):
    # every seventh text claims to be English
    said = F.when(F.col("doc_id") % 7 == 0, F.lit("en")).otherwise(F.col("lang"))
    rows = load(spark, d, "documents").select("doc_id", said.alias("said"), F.regexp_replace(F.lower("text"), r"[^\p{L}]", "").alias("l"))
    strange = F.col("l")
    for lang, more in LETTERS.items():
        strange = F.when(F.col("said") == lang, F.translate("l", f"abcdefghijklmnopqrstuvwxyz{more}", "")).otherwise(strange)
    counted = rows.select("doc_id", F.length("l").cast("long").alias("letters"), F.length(strange).cast("long").alias("strange"))
    return counted.withColumn("mismatch", F.col("strange") > 0.02 * F.col("letters"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def x_events_tumbling(spark, d):
    w = load(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "value")


@query("""WITH s AS (SELECT *, sum(CAST(gap IS NULL OR gap >= INTERVAL 30 MINUTE AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events))
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def x_events_session(spark, d):
    w = load(spark, d, "events").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def x_star_revenue(spark, d):
    lines, orders, customer, nation = load(spark, d, "lineitem", "orders", "customer", "nation")
    # revenue by order first: fewer rows for the joins, and orders are counted without a distinct
    per = lines.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    joined = per.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"), F.count("*").alias("orders"))
