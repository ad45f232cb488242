"""Provider layer (L1-L14, S16): prompts, prices, retries and mock calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import provider
from .joins import PRICED_SQL, calls, prices
from .registry import load, query


@query("""SELECT conv_id, CASE WHEN conv_id % 4 = 3 THEN 'user' ELSE role END AS role, CAST(count(*) AS BIGINT) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars
FROM (SELECT conv_id, role, text FROM conversations WHERE conv_id % 4 <> 3 UNION ALL SELECT conv_id, 'user', string_agg(text, ' ' ORDER BY turn) FROM conversations WHERE conv_id % 4 = 3 GROUP BY conv_id) GROUP BY ALL""")
def l1_prompt_roles(spark, d):
    turns = load(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    listed = F.to_json(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))))
    parts = F.to_json(F.transform("t", lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["text"].alias("text"))).alias("content"))))
    nested = F.concat(F.lit('{"messages": '), listed, F.lit("}"))
    plain = F.array_join(F.transform("t", lambda x: x["text"]), " ")
    n = F.col("conv_id") % 4
    raw = F.when(n == 0, listed).when(n == 1, parts).when(n == 2, nested).otherwise(plain)
    flat = turns.select("conv_id", F.explode(provider.messages(raw)).alias("m"))
    return flat.groupBy("conv_id", F.col("m.role").alias("role")).agg(F.count("*").alias("messages"), F.sum(F.length("m.text")).alias("chars"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'system' ELSE role END AS role, CASE WHEN turn % 5 = 4 THEN 'image in a text-only provider' END AS error FROM conversations")
def l2_provider_roles(spark, d):
    raw = F.when(F.col("turn") % 3 == 2, F.lit("function")).otherwise(F.col("role"))
    return load(spark, d, "conversations").select("conv_id", "turn", provider.provider_role(raw).alias("role"), F.when(F.col("turn") % 5 == 4, F.lit("image in a text-only provider")).alias("error"))


@query("SELECT conv_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'system'), '') AS system, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'user'), '') AS user FROM conversations GROUP BY conv_id")
def l3_concat_by_role(spark, d):
    return provider.joined_by_role(load(spark, d, "conversations"), "conv_id", "turn")


@query("SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS text FROM (SELECT conv_id, turn, text AS line FROM conversations) GROUP BY conv_id")
def l4_ocr_text(spark, d):
    lines = load(spark, d, "conversations").select("conv_id", "turn", F.transform(F.split("text", " "), lambda w: F.struct(w.alias("text"))).alias("words"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("turn", "words"))), lambda x: F.struct(x["words"].alias("words")))
    pages = lines.groupBy("conv_id").agg(F.array(F.struct(F.array(F.struct(blocks.alias("lines"))).alias("blocks"))).alias("pages"))
    return pages.select("conv_id", provider.ocr_text(F.col("pages")).alias("text"))


def _answers(spark, d):
    e = load(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 6 > 0, F.concat("event_type", F.col("event_id").cast("string"))).alias("name"), F.when(F.col("event_id") % 7 > 0, F.col("value").cast("string")).otherwise(F.lit("n/a")).alias("confidence"))
    return e.groupBy("user_id").agg(F.array(F.collect_list(F.struct("name", "confidence"))).alias("answers"))


@query("SELECT user_id, count(*) AS labels, round(sum(value), 4) AS confidence FROM events WHERE event_id % 6 > 0 AND event_id % 7 > 0 GROUP BY user_id")
def l5_labels(spark, d):
    flat = _answers(spark, d).select("user_id", F.explode(provider.labels(F.col("answers"))).alias("x"))
    return flat.groupBy("user_id").agg(F.count("*").alias("labels"), F.round(F.sum(F.col("x.confidence").cast("double")), 4).alias("confidence"))


@query("SELECT user_id, string_agg(printf('%s (%.3f)', name, value), ', ' ORDER BY value DESC, name) AS block FROM (SELECT user_id, event_type || event_id AS name, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type || event_id) AS r FROM events WHERE event_id % 6 > 0 AND event_id % 7 > 0) WHERE r <= 3 GROUP BY user_id")
def l6_render(spark, d):
    found = F.transform(provider.labels(F.col("answers")), lambda x: F.struct(x["name"].alias("name"), x["confidence"].cast("double").alias("confidence")))
    return _answers(spark, d).select("user_id", provider.rendered_labels(found).alias("block")).where("block <> ''")


@query(f"WITH {PRICED_SQL} SELECT event_id, price_key, coalesce(rate, 0) AS rate, 0.5::DOUBLE AS image_rate FROM priced")
def l7_price_resolve(spark, d):
    table = prices(spark).withColumn("image_rate", F.lit(0.2))
    return provider.priced(calls(spark, d).select("event_id", "model"), table, "model", ["rate", "image_rate"], {"image_rate": 0.5}).select("event_id", "price_key", "rate", "image_rate")


@query(f"WITH {PRICED_SQL} SELECT model, count(*) AS calls, round(sum((tokens * coalesce(rate, 0) + 2 * tokens * coalesce(rate, 0)) / 1000), 6) AS cost FROM priced GROUP BY model")
def l8_cost(spark, d):
    p = provider.priced(calls(spark, d), prices(spark), "model", ["rate"])
    cost = provider.token_cost(F.col("tokens"), 2 * F.col("tokens"), F.col("rate"), F.col("rate"))
    return p.groupBy("model").agg(F.count("*").alias("calls"), F.round(F.sum(cost), 6).alias("cost"))


@query("SELECT event_id, CAST(CASE WHEN after >= 0 THEN least(after * 1000, 30000) ELSE round(least(1000 * pow(2, attempt) * (0.75 + 0.5 * jitter), 30000)) END AS BIGINT) AS wait FROM (SELECT event_id, event_id % 11 AS attempt, CASE WHEN event_id % 3 = 0 THEN event_id % 50 - 5 END AS after, (event_id % 100) / 100 AS jitter FROM events)")
def l9_backoff(spark, d):
    n = F.col("event_id")
    return load(spark, d, "events").select("event_id", provider.backoff(n % 11, F.when(n % 3 == 0, n % 50 - 5), (n % 100) / 100).alias("wait"))


@query("SELECT event_id, attempt, attempt >= event_id % 7 AS ok FROM (SELECT event_id, unnest(range(0, least(event_id % 7, 4) + 1))::INT AS attempt FROM events WHERE event_type = 'error')")
def l10_attempts(spark, d):
    e = load(spark, d, "events").where("event_type = 'error'").select("event_id")
    return provider.attempts(e, F.col("event_id") % 7)


@query("SELECT status, count(*) AS n, bool_or(retry) AS retry FROM (SELECT status, status = 429 OR status BETWEEN 500 AND 599 AS retry FROM (SELECT list_extract([200, 400, 429, 500, 503, 404], CAST(event_id % 6 AS INT) + 1) AS status FROM events)) GROUP BY status")
def l11_retryable(spark, d):
    status = F.element_at(F.array(*map(F.lit, (200, 400, 429, 500, 503, 404))), (F.col("event_id") % 6 + 1).cast("int"))
    e = load(spark, d, "events").select(status.alias("status"))
    return e.groupBy("status").agg(F.count("*").alias("n"), F.bool_or(provider.retryable(F.col("status"))).alias("retry"))


@query("SELECT status, count(*) AS n, bool_or(status IN (429, 503)) AS retry FROM (SELECT list_extract([200, 400, 429, 500, 503, 404], CAST(event_id % 6 AS INT) + 1) AS status FROM events) GROUP BY status")
def l10_narrow_statuses(spark, d):
    status = F.element_at(F.array(*map(F.lit, (200, 400, 429, 500, 503, 404))), (F.col("event_id") % 6 + 1).cast("int"))
    e = load(spark, d, "events").select(status.alias("status"))
    return e.groupBy("status").agg(F.count("*").alias("n"), F.bool_or(provider.retryable(F.col("status"), (429, 503), server_errors=False)).alias("retry"))


@query("""WITH e AS (SELECT event_id, list_extract(['ECONNRESET', 'EPERM', NULL, 'UND_ERR_SOCKET', 'ENOTFOUND', NULL, NULL], CAST(event_id % 7 AS INT) + 1) AS code, CASE WHEN event_id % 5 = 0 THEN 'EPIPE' END AS cause,
list_extract(['Error', 'TypeError', 'AbortError'], CAST(event_id % 3 AS INT) + 1) AS name, list_extract(['network is down', 'Fetch failed', 'timeout'], CAST(event_id % 4 % 3 AS INT) + 1) AS message FROM events)
SELECT event_id, coalesce(code IN ('ECONNRESET', 'UND_ERR_SOCKET', 'ENOTFOUND'), false) OR coalesce(cause = 'EPIPE', false) OR (name = 'TypeError' AND message = 'Fetch failed') OR name = 'AbortError' AS retry FROM e""")
def l11_broken_connections(spark, d):
    n = F.col("event_id")

    def pick(*values):
        return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))

    message = F.element_at(F.array(*map(F.lit, ("network is down", "Fetch failed", "timeout"))), (n % 4 % 3 + 1).cast("int"))
    retry = provider.broken_connection(pick("ECONNRESET", "EPERM", None, "UND_ERR_SOCKET", "ENOTFOUND", None, None), F.when(n % 5 == 0, F.lit("EPIPE")), pick("Error", "TypeError", "AbortError"), message)
    return load(spark, d, "events").select("event_id", retry.alias("retry"))


@query("""WITH calls AS (SELECT event_id, user_id % 5 AS owner, ts FROM events), tokens AS (SELECT DISTINCT user_id % 5 AS owner, ts AS issued FROM events WHERE event_type = 'purchase')
SELECT event_id, CASE WHEN ts < issued + INTERVAL 1680 SECOND THEN issued END AS issued FROM calls ASOF LEFT JOIN tokens ON calls.owner = tokens.owner AND calls.ts >= tokens.issued""")
def l12_tokens(spark, d):
    e = load(spark, d, "events").withColumn("owner", F.col("user_id") % 5)
    tokens = e.where("event_type = 'purchase'").select("owner", F.col("ts").alias("issued")).distinct()
    return provider.with_tokens(e.select("event_id", "owner", "ts"), tokens, "owner", "ts", 1800).select("event_id", "issued")


@query("""WITH up AS (SELECT doc_id, sha256(text) AS content, TIMESTAMP '2024-01-02 00:00:00' + to_hours(CAST(doc_id % 30 AS INT)) AS moment FROM documents),
cache AS (SELECT content, max(doc_id) AS file_id FROM up WHERE doc_id % 3 = 0 GROUP BY content)
SELECT doc_id, CASE WHEN moment <= TIMESTAMP '2024-01-02 00:00:00' + INTERVAL 24 HOUR THEN file_id END AS file_id FROM up LEFT JOIN cache USING (content)""")
def l12_file_ids(spark, d):
    day = F.lit("2024-01-02").cast("timestamp")
    up = load(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content"), (day + F.make_dt_interval(F.lit(0), (F.col("doc_id") % 30).cast("int"))).alias("at"))
    cache = up.where("doc_id % 3 = 0").select("content", F.col("doc_id").alias("file_id"), day.alias("uploaded_at"))
    return provider.file_ids(up, cache, "content", "at").select("doc_id", "file_id")


@query("SELECT sha256(text) AS content, count(*) AS uses, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def l12_content_cache(spark, d):
    return load(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("content")).agg(F.count("*").alias("uses"), F.min("doc_id").alias("first")).where("uses > 1")


@query("""SELECT conv_id, turn, CASE WHEN role <> 'system' THEN '{"violations":[],"verdict":"approve"}' END AS output, CASE WHEN role = 'system' THEN 'empty prompt' END AS error, CASE WHEN role = 'system' THEN 0 ELSE CAST(ceil(length(text) / 4) AS BIGINT) END AS prompt_tokens, CASE WHEN role = 'system' THEN 0 ELSE 10 END::BIGINT AS completion_tokens FROM conversations""")
def l13_mock_calls(spark, d):
    prompts = load(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") != "system", F.col("text")).alias("prompt"))
    return provider.mock_calls(prompts, "prompt").select("conv_id", "turn", "output", "error", "prompt_tokens", "completion_tokens")


@query("SELECT error IS NULL AS answered, count(*) AS n FROM (SELECT CASE WHEN role = 'system' THEN 'empty prompt' END AS error FROM conversations) GROUP BY 1")
def l14_error_rows(spark, d):
    return l13_mock_calls(spark, d).groupBy(F.col("error").isNull().alias("answered")).agg(F.count("*").alias("n"))
