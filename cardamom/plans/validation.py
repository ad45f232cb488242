"""Validation (V1-V13) and nested fields (P25, P26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as ft
from ..operators import audit, blocklist, joins, jsonschema, leaves, sampling, validation
from .registry import load, query


def _checks():
    return {"id": F.col("doc_id") > 0, "lang": F.col("lang").isin("en", "fr", "de"), "text": F.length("text") >= 60, "n_chars": F.col("n_chars") == F.length("text")}


@query("""SELECT doc_id, array_to_string([x FOR x IN [CASE WHEN NOT doc_id > 0 THEN 'id' END, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'lang' END, CASE WHEN length(text) < 60 THEN 'text' END, CASE WHEN n_chars <> length(text) THEN 'n_chars' END] IF x IS NOT NULL], ',') AS errors FROM documents WHERE doc_id <= 0 OR lang = 'es' OR length(text) < 60""")
def v1_rejects(spark, d):
    _, rejected = validation.split(load(spark, d, "documents"), _checks())
    return rejected.select("doc_id", F.array_join("_validation_errors", ",").alias("errors"))


@query("SELECT event_id, CASE WHEN event_id % 8 = 0 THEN 'extra' ELSE '' END AS unknown FROM events")
def v1_unknown_keys(spark, d):
    json = F.when(F.col("event_id") % 8 == 0, F.lit('{"k": 1, "extra": 2}')).otherwise(F.col("props"))
    return load(spark, d, "events").select("event_id", F.array_join(validation.unknown_keys(json, ["k"]), ",").alias("unknown"))


#: Orders with their lines as cards. The text of an order is JSON with nested arrays and objects.
ORDER_CARD = {
    "type": "object",
    "required": ["id", "status", "lines"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "pattern": "^[0-9]+$"},
        "status": {"enum": ["F", "O", "P"]},
        "lines": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/line"}},
    },
    "$defs": {
        "line": {
            "type": "object",
            "required": ["no", "ship"],
            "additionalProperties": False,
            "properties": {
                "no": {"type": "integer", "minimum": 1},
                "quantity": {"type": "number", "exclusiveMinimum": 0},
                "ship": {"type": "object", "additionalProperties": False, "required": ["flag"], "properties": {"flag": {"type": "string", "minLength": 1}, "date": {"type": "string", "format": "date"}}},
            },
        }
    },
}


@query("""WITH l AS (
  SELECT o_orderkey AS k, l_linenumber AS n, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag, l_shipdate) - 1 AS i
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
), k AS (SELECT DISTINCT k FROM l)
SELECT k AS order_id, '' AS path, 'required' AS keyword, 'status' AS detail FROM k WHERE k % 7 = 0
UNION ALL SELECT k, '', 'additionalProperties', 'colour' FROM k WHERE k % 11 = 0
UNION ALL SELECT k, '/lines/' || i || '/no', 'minimum', '1' FROM l WHERE (k + n) % 13 = 0
UNION ALL SELECT k, '/lines/' || i || '/ship/date', 'format', 'date' FROM l WHERE (k + n) % 17 = 0
UNION ALL SELECT k, '/lines/' || i || '/ship', 'additionalProperties', 'by' FROM l WHERE (k + n) % 19 = 0""")
def v1_schema(spark, d):
    """Errors at three depths of cards made of orders and lines, by a compiled schema."""
    orders, lines = load(spark, d, "orders", "lineitem")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    date = F.when((k + n) % 17 == 0, F.lit("soon")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    ship = F.struct(F.col("l_returnflag").alias("flag"), date.alias("date"), F.when((k + n) % 19 == 0, F.lit("me")).alias("by"))
    line = F.struct(F.when((k + n) % 13 == 0, F.lit(0)).otherwise(n).alias("no"), F.col("l_quantity").alias("quantity"), ship.alias("ship"))
    # an order has few lines; the sort key comes first
    of_order = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag", "l_shipdate", line.alias("line")))).alias("lines"))
    key = F.col("o_orderkey")
    card = F.struct(key.cast("string").alias("id"), F.when(key % 7 != 0, F.col("o_orderstatus")).alias("status"), F.when(key % 11 == 0, F.lit("red")).alias("colour"), F.transform("lines", lambda x: x["line"]).alias("lines"))
    cards = orders.join(of_order, key == F.col("l_orderkey")).select(key.alias("order_id"), F.to_json(card).alias("card"))
    found = jsonschema.validated(cards, "card", jsonschema.Schema(ORDER_CARD), "errors")
    # a plain explode would have its input computed once more, for a filter on its size
    return found.select("order_id", F.explode_outer("errors").alias("e")).where("e is not null").select("order_id", "e.path", "e.keyword", "e.detail")


@query("SELECT doc_id, CASE WHEN quality = 1 OR doc_id % 5 = 0 THEN toxic = 0 ELSE toxic = 1 END AS consistent FROM labels")
def v2_consistency(spark, d):
    clean = F.when(F.col("doc_id") % 5 > 0, F.col("quality") == 1)
    violations = F.when(F.col("toxic") == 1, F.array(F.lit("v"))).otherwise(F.array().cast("array<string>"))
    return load(spark, d, "labels").select("doc_id", validation.consistent(clean, violations).alias("consistent"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'clean' ELSE 'dirty' END AS placed FROM labels WHERE (doc_id % 2 = 0) <> NOT (quality = 0 OR (doc_id % 3 = 0 AND toxic = 1))")
def v3_misplaced(spark, d):
    # dirty: the text is, or the image flag is false; a null flag doesn't count
    flag = F.when(F.col("doc_id") % 3 == 0, F.col("toxic") == 0)
    dirty = (F.col("quality") == 0) | F.coalesce(~flag, F.lit(False))
    placed = F.when(F.col("doc_id") % 2 == 0, F.lit("clean")).otherwise(F.lit("dirty"))
    return load(spark, d, "labels").where((placed == "dirty") != dirty).select("doc_id", placed.alias("placed"))


@query("SELECT page_id, 'case_' || page_id || '.json' AS file, page_id % 6 > 0 AS valid FROM pages")
def v4_file_names(spark, d):
    pages = load(spark, d, "pages").select("page_id", F.concat(F.lit("dir/case_"), F.col("page_id").cast("string"), F.lit(".json")).alias("path"))
    case_id = F.when(F.col("page_id") % 6 > 0, F.concat(F.lit("case_"), F.col("page_id").cast("string"))).otherwise(F.lit("other"))
    file = F.regexp_extract("path", r"([^/]+)$", 1)
    return pages.select("page_id", file.alias("file"), (F.regexp_replace(file, r"\.json$", "") == case_id).alias("valid"))


def _cards(spark, d):
    """Nested cards: orders with their lines as program items."""
    orders, lines, part = load(spark, d, "orders", "lineitem", "part")
    item = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("order"), F.col("p_name").alias("title"), F.col("l_returnflag").alias("description")))).alias("program_items")
    )
    cards = orders.join(item, "o_orderkey", "left")
    return cards.select("o_orderkey", F.struct(F.col("o_orderpriority").alias("title"), "program_items", F.struct(F.col("o_orderstatus").alias("address")).alias("location")).alias("card"))


CARDS = """items AS (SELECT l_orderkey AS o_orderkey, l_linenumber, p_name, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, p_name, l_returnflag) - 1 AS i FROM lineitem JOIN part ON l_partkey = p_partkey),
leaves AS (SELECT o_orderkey, 'title' AS path, o_orderpriority AS text FROM orders UNION ALL SELECT o_orderkey, 'location.address', o_orderstatus FROM orders
UNION ALL SELECT o_orderkey, 'program_items[' || i || '].title', p_name FROM items SEMI JOIN orders USING (o_orderkey)
UNION ALL SELECT o_orderkey, 'program_items[' || i || '].description', l_returnflag FROM items SEMI JOIN orders USING (o_orderkey))"""


@query(f"WITH {CARDS} SELECT * FROM leaves")
def p26_leaf_flatten(spark, d):
    return validation.flatten(_cards(spark, d), "card", ["o_orderkey"])


@query("""WITH l AS (SELECT l_orderkey AS k, l_returnflag AS f, l_linestatus AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) - 1 AS i FROM lineitem SEMI JOIN orders ON o_orderkey = l_orderkey)
SELECT o_orderkey, 'title' AS path, o_orderpriority AS text FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT k, 'lines[' || i || '].flag', f FROM l WHERE k % 3 = 0
UNION ALL SELECT k, 'lines[' || i || '].more.status', s FROM l WHERE k % 3 = 0
UNION ALL SELECT o_orderkey, 'a.b[1][0].c.d', o_orderstatus FROM orders WHERE o_orderkey % 3 = 1
UNION ALL SELECT o_orderkey, 'a.e', o_orderpriority FROM orders WHERE o_orderkey % 3 = 1
UNION ALL SELECT o_orderkey, '', o_orderpriority FROM orders WHERE o_orderkey % 3 = 2""")
def p26_json_leaves(spark, d):
    """Orders as cards of three shapes in one table, with nothing told about any of them."""
    orders, lines = load(spark, d, "orders", "lineitem")
    line = F.struct("l_linenumber", "l_returnflag", "l_linestatus")
    of_order = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("l"))
    key, status, title = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    made = F.transform("l", lambda x: F.struct(x["l_linenumber"].alias("no"), x["l_returnflag"].alias("flag"), F.struct(x["l_linestatus"].alias("status"), F.lit(True).alias("ok")).alias("more")))
    deep = F.struct(F.struct(F.array(F.array(), F.array(F.struct(F.struct(status.alias("d")).alias("c")))).alias("b"), title.alias("e")).alias("a"), key.alias("n"))
    card = F.when(key % 3 == 0, F.to_json(F.struct(title.alias("title"), made.alias("lines")))).when(key % 3 == 1, F.to_json(deep)).otherwise(F.concat(F.lit('"'), title, F.lit('"')))
    cards = orders.join(of_order, "o_orderkey", "left").select("o_orderkey", card.alias("card"))
    return leaves.flatten_json(cards, "card", ["o_orderkey"])


@query(f"""WITH {CARDS}, claims AS (SELECT o_orderkey, CASE o_orderkey // 10 % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'program_items[1].title' WHEN 2 THEN 'program_items[9].title' ELSE 'location' END AS path, CASE WHEN o_orderkey % 30 = 0 THEN 'i' ELSE 'e' END AS quote FROM orders)
SELECT c.o_orderkey, c.path, c.quote, coalesce(contains(text, quote), false) AS found FROM claims c LEFT JOIN leaves USING (o_orderkey, path)""")
def p25_quote_check(spark, d):
    cards = _cards(spark, d)
    n = F.col("o_orderkey")
    turn = F.floor(n / 10) % 4
    path = F.when(turn == 0, F.lit("title")).when(turn == 1, F.lit("program_items[1].title")).when(turn == 2, F.lit("program_items[9].title")).otherwise(F.lit("location"))
    claims = cards.select("o_orderkey", path.alias("path"), F.when(n % 30 == 0, F.lit("i")).otherwise(F.lit("e")).alias("quote"))
    return validation.quoted(claims, validation.flatten(cards, "card", ["o_orderkey"]), "o_orderkey").select("o_orderkey", "path", "quote", "found")


@query("SELECT doc_id, 'text' AS path, substr(text, 5, 12) || CASE WHEN doc_id % 4 = 0 THEN '~~' ELSE '' END AS quote FROM documents WHERE doc_id % 4 = 0 OR length(text) < 5")
def v5_quote_missing(spark, d):
    docs = load(spark, d, "documents")
    claims = docs.select("doc_id", F.lit("text").alias("path"), F.concat(F.substring("text", 5, 12), F.when(F.col("doc_id") % 4 == 0, F.lit("~~")).otherwise(F.lit(""))).alias("quote"))
    leaves = docs.select("doc_id", F.lit("text").alias("path"), "text")
    return validation.quoted(claims, leaves, "doc_id").where("not found").select("doc_id", "path", "quote")


@query("""SELECT case_id, CASE WHEN NOT regexp_matches(case_id, '^synth_src\\d+_\\d{3}$') THEN 'error' WHEN quality IS NULL THEN 'skip' WHEN quality = 1 AND toxic = 1 THEN 'error' WHEN doc_id % 11 = 0 THEN 'warn' ELSE 'ok' END AS level
FROM (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'real_' ELSE 'synth_' END || source || '_' || lpad(CAST(number AS VARCHAR), greatest(3, length(CAST(number AS VARCHAR)))::INT, '0') AS case_id, quality, toxic
      FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number FROM documents) LEFT JOIN labels USING (doc_id))""")
def v6_pending_levels(spark, d):
    docs, labels = load(spark, d, "documents", "labels")
    n = F.col("doc_id")
    # a running number within the source: ids of the whole table don't fit the three digits
    docs = sampling.numbered(docs.select("doc_id", "source"), "source", F.lit(0), ["doc_id"])
    number = F.col("number").cast("string")
    case_id = F.concat(F.when(n % 13 == 0, F.lit("real_")).otherwise(F.lit("synth_")), "source", F.lit("_"), F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0")))
    level = (
        F.when(~F.rlike(case_id, F.lit(r"^synth_src\d+_\d{3}$")), F.lit("error")).when(F.col("quality").isNull(), F.lit("skip"))
        .when((F.col("quality") == 1) & (F.col("toxic") == 1), F.lit("error")).when(n % 11 == 0, F.lit("warn")).otherwise(F.lit("ok"))
    )
    return docs.join(labels, "doc_id", "left").select(case_id.alias("case_id"), level.alias("level"))


@query("""WITH l AS (SELECT doc_id, lang, CAST(length(text) AS INT) AS len FROM documents), b AS (SELECT lang, list_sort(list(len))[least(count(*) - 1, floor(count(*) * 0.05))::INT + 1] AS lo, list_sort(list(len))[least(count(*) - 1, floor(count(*) * 0.95))::INT + 1] AS hi FROM l WHERE len > 0 GROUP BY lang)
SELECT doc_id, lang, len FROM l JOIN b USING (lang) WHERE NOT len BETWEEN lo AND hi""")
def v7_length_outliers(spark, d):
    rows = load(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("len"))
    return validation.outside(rows, "len", audit.percentile_bounds(rows, ["lang"], "len"), ["lang"]).select("doc_id", "lang", "len")


@query(r"""WITH p AS (SELECT item_id, lower(regexp_extract(text, '[A-Za-z]{4,}')) || '[a-z]* [a-z]' AS re FROM benchmark WHERE regexp_matches(text, '[A-Za-z]{4,}'))
SELECT doc_id, CAST(item_id AS VARCHAR) AS pattern, regexp_extract(text, re, 0, 'i') AS match FROM documents CROSS JOIN p WHERE regexp_extract(text, re, 0, 'i') <> ''""")
def v8_long_blocklist(spark, d):
    """A pattern for each item of the benchmark: its first word of four letters, whatever ends it, and the letter after it."""
    docs, items = load(spark, d, "documents", "benchmark")
    word = F.lower(F.regexp_extract("text", "[A-Za-z]{4,}", 0))
    listed = items.select(F.col("item_id").cast("string").alias("id"), word.alias("word")).where("word != ''")
    # the list is as long as the benchmark
    patterns = [(r["id"], r["word"] + "[a-z]* [a-z]") for r in listed.orderBy("id").collect()]
    return blocklist.blocked(docs.select("doc_id", "text"), "text", patterns)


@query(r"SELECT doc_id, pattern, regexp_extract(text, re) AS match FROM documents CROSS JOIN (VALUES ('shout', '!!+'), ('guarantee', '100\s*%'), ('worst', '(worthless|pathetic)[a-z]*')) p(pattern, re) WHERE regexp_extract(text, re) <> ''")
def v8_blocklist(spark, d):
    return joins.pattern_hits(load(spark, d, "documents").select("doc_id", "text"), "text", {"shout": "!!+", "guarantee": r"100\s*%", "worst": "(worthless|pathetic)[a-z]*"})


@query(r"""WITH k AS (SELECT source, lang || ':' || array_to_string([w FOR w IN regexp_split_to_array(lower(trim(text)), '\s+') IF w <> ''][1:3], ' ') AS key FROM documents)
SELECT source, count(*) AS n, CASE WHEN count(*) < 5 THEN 1.0 ELSE count(DISTINCT key) / count(*) END AS ratio, count(*) >= 5 AND count(DISTINCT key) / count(*) < 0.4 AS warning FROM k GROUP BY source""")
def v9_diversity(spark, d):
    rows = load(spark, d, "documents").select("source", ft.topic_key(F.lit(None).cast("string"), F.col("lang"), F.col("text")).alias("key"))
    return validation.diversity(rows, ["source"], "key")


@query("SELECT CAST(count(*) FILTER (length(text) < 60) AS BIGINT) AS errors, CAST(count(*) FILTER (length(text) >= 60 AND lang = 'es') AS BIGINT) AS warnings, 0::BIGINT AS errors_if_warn_only FROM documents")
def v11_levels(spark, d):
    level = F.when(F.length("text") < 60, F.lit("error")).when(F.col("lang") == "es", F.lit("warn")).otherwise(F.lit("ok"))
    marked = load(spark, d, "documents").select(level.alias("level"))
    lowered = F.when(F.col("level") == "error", F.lit("warn")).otherwise(F.col("level"))
    return marked.agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warn").alias("warnings"), F.count_if(lowered == "error").alias("errors_if_warn_only"))


@query("SELECT s_name AS source, CASE WHEN s_nationkey < 1 THEN 'target_total' WHEN s_suppkey % 9 = 0 THEN 'seed' END AS error FROM supplier WHERE s_nationkey < 1 OR s_suppkey % 9 = 0")
def v12_config_errors(spark, d):
    config = load(spark, d, "supplier").select(F.col("s_name").alias("source"), F.col("s_nationkey").alias("target_total"), F.when(F.col("s_suppkey") % 9 > 0, F.col("s_suppkey")).alias("seed"))
    error = F.get(validation.errors({"target_total": F.col("target_total") >= 1, "seed": F.col("seed").isNotNull()}), F.lit(0))
    return config.select("source", error.alias("error")).where("error is not null")


@query("SELECT conv_id, turn, NOT contains(text, quote) AS hallucinated FROM (SELECT conv_id, turn, text, substr(text, 2, 15) || CASE WHEN turn % 2 = 1 THEN '#' ELSE '' END AS quote FROM conversations)")
def v13_hallucinations(spark, d):
    quote = F.concat(F.substring("text", 2, 15), F.when(F.col("turn") % 2 == 1, F.lit("#")).otherwise(F.lit("")))
    return load(spark, d, "conversations").select("conv_id", "turn", (~F.contains("text", quote)).alias("hallucinated"))
