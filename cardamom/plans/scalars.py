"""Text and page functions over the driver's tables (P1-P35, S and K features that need no files)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as ft
from ..functions import web
from .registry import load, query


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def p1_excerpt(spark, d):
    nested = load(spark, d, "documents").select(F.struct("*").alias("card"))
    return nested.select(ft.excerpt("card", ["doc_id", "lang", "source", "n_chars"]).alias("e")).select("e.*")


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('  ' || text || chr(10) || chr(10) || chr(10) || 'end', chr(160), ' ', 'g'), '\s+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def p2_normalise(spark, d):
    raw = F.concat(F.lit("  "), "text", F.lit("\n\n\nend"))
    return load(spark, d, "documents").select("doc_id", F.md5(ft.normalise(raw)).alias("digest"))


@query(r"""WITH l AS (SELECT page_id, url, unnest(list_concat(regexp_extract_all(html, '<a\b[^>]*?\bhref="([^"]*)"', 1), ['', 'https://other.example/x', '//cdn.example/y', '?q=1', 'mailto:a@b.example'])) AS href FROM pages)
SELECT page_id, href, CASE WHEN href = '' THEN NULL WHEN regexp_matches(href, '^[a-z]+:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^[a-z]+:') || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || href
WHEN starts_with(href, '?') THEN regexp_replace(url, '[?#].*$', '') || href END AS link FROM l""")
def p3_absolute_urls(spark, d):
    pages = load(spark, d, "pages")
    made = F.array(*map(F.lit, ("", "https://other.example/x", "//cdn.example/y", "?q=1", "mailto:a@b.example")))
    links = pages.select("page_id", "url", F.explode(F.concat(web.attribute_values(F.col("html"), "a", "href"), made)).alias("href"))
    return links.select("page_id", "href", web.absolute_url("url", "href").alias("link"))


@query(r"""SELECT page_id, coalesce(regexp_extract(html, '<html[^>]*\blang="([^"]*)"', 1), '') AS lang, regexp_extract(html, '<meta[^>]*\bcharset="([^"]*)"', 1) AS charset, '' AS description FROM pages""")
def p4_meta(spark, d):
    return load(spark, d, "pages").select("page_id", F.regexp_extract("html", r'<html[^>]*\blang="([^"]*)"', 1).alias("lang"), F.regexp_extract("html", r'<meta[^>]*\bcharset="([^"]*)"', 1).alias("charset"), web.meta_content(F.col("html"), "description").alias("description"))


@query("SELECT page_id, 'https://x.example/' || page_id || '.jpg,https://x.example/lazy.png,https://x.example/' || page_id || '-1x.webp' AS urls FROM pages")
def p5_image_urls(spark, d):
    n = F.col("page_id").cast("string")
    marks = F.concat(F.lit('<img src="https://x.example/'), n, F.lit('.jpg" alt=""><img class="l" data-src="/local.png" data-lazy="https://x.example/lazy.png"><img srcset="https://x.example/'), n, F.lit('-1x.webp 1x, https://x.example/2x.webp 2x"><img src="https://x.example/'), n, F.lit('.jpg">'))
    return load(spark, d, "pages").select("page_id", F.array_join(web.image_urls(F.concat("html", marks)), ",").alias("urls"))


@query("SELECT part_key, CAST(nullif(round(h * 60) + m + dd * 1440, 0) AS INT) AS minutes FROM (SELECT p_partkey AS part_key, p_size / 2 AS h, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 60 ELSE 0 END AS m, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 4 ELSE 0 END AS dd FROM part)")
def p6_duration(spark, d):
    n = F.col("p_partkey")
    raw = F.concat_ws(
        " ",
        F.when(n % 2 == 0, F.format_string("%.1f часа", F.col("p_size") / 2)).otherwise(F.regexp_replace(F.format_string("%.1f Ч", F.col("p_size") / 2), r"\.", ",")),
        F.when(n % 3 == 0, F.concat((n % 60).cast("string"), F.lit(" минут"))), F.when(n % 5 == 0, F.concat((n % 4).cast("string"), F.lit(" дня"))),
    )
    return load(spark, d, "part").select(n.alias("part_key"), ft.duration_minutes(raw).alias("minutes"))


@query("SELECT p_partkey AS part_key, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS least, CASE WHEN p_partkey % 3 < 2 THEN p_size + 5 END AS most FROM part")
def p7_group_size(spark, d):
    n, s = F.col("p_partkey") % 3, F.col("p_size")
    raw = F.when(n == 0, F.concat(F.lit("Группа от "), s.cast("string"), F.lit(" до "), (s + 5).cast("string"))).when(n == 1, F.concat(F.lit("до "), (s + 5).cast("string"), F.lit(" человек"))).otherwise(F.lit("любая"))
    return load(spark, d, "part").select(F.col("p_partkey").alias("part_key"), ft.group_size(raw).alias("g")).select("part_key", F.col("g.min").alias("least"), F.col("g.max").alias("most"))


@query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1) AS lang, CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS id FROM pages")
def p8_url_parse(spark, d):
    parts = web.path_parts(F.col("url"))
    return load(spark, d, "pages").select("page_id", web.host(F.col("url")).alias("host"), F.get(parts, F.lit(0)).alias("lang"), F.regexp_extract(F.get(parts, F.lit(1)), r"^(\d+)", 1).cast("long").alias("id"))


@query(r"SELECT page_id, candidate FROM (SELECT page_id, page_id % 4 = 0 AND NOT regexp_matches(url, '^[a-z]+://[^/]+/de/') AS candidate FROM pages)")
def p9_candidates(spark, d):
    pages = load(spark, d, "pages")
    slug = F.when(F.col("page_id") % 4 == 0, F.lit("tour-of-old-town")).when(F.col("page_id") % 4 == 1, F.lit("a-b-c")).when(F.col("page_id") % 4 == 2, F.lit("a-long-slug-here/more")).otherwise(F.lit("withouthyphens"))
    made = F.concat(F.lit("https://"), web.host(F.col("url")), F.lit("/"), F.when(F.contains("url", F.lit("/de/")), F.lit("de/")).otherwise(F.lit("")), slug, F.lit("?x=1"))
    good = web.candidate(F.regexp_replace(made, r"^https://[^/]*", "https://h.example"), ["h.example"], "^/(about|help)")
    return pages.select("page_id", good.alias("candidate"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN (doc_id % 18) || '+' WHEN doc_id % 4 = 1 THEN (doc_id % 21) || '+' END AS age FROM documents")
def p10_age(spark, d):
    n = F.col("doc_id")
    meta = F.when(n % 4 == 0, F.concat((n % 18).cast("string"), F.lit("+"))).otherwise(F.lit(""))
    body = F.when(n % 4 == 1, F.concat(F.lit("Вход От "), (n % 21).cast("string"), F.lit(" лет"))).otherwise(F.lit("нет"))
    return load(spark, d, "documents").select("doc_id", ft.age_restriction(meta, body).alias("age"))


@query("SELECT o_orderkey, CASE WHEN count(l_linenumber) FILTER (l_linenumber >= 4) >= 2 THEN 'tour' ELSE 'excursion' END AS product_type FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def p11_product_type(spark, d):
    orders, lines = load(spark, d, "orders", "lineitem")
    badges = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("days"))
    days = F.size(F.filter(F.coalesce("days", F.array().cast("array<int>")), lambda x: x >= 4))
    return orders.select("o_orderkey").join(badges, "o_orderkey", "left").select("o_orderkey", F.when(days >= 2, F.lit("tour")).when(days == 1, F.lit("excursion")).otherwise(F.lit("excursion")).alias("product_type"))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT strftime(ts + INTERVAL (event_id % 90) DAY, '%Y-%m-%d')))[1:50], ',') AS dates FROM events GROUP BY user_id")
def p12_dates(spark, d):
    day = F.date_format(F.col("ts") + F.make_dt_interval((F.col("event_id") % 90).cast("int")), "yyyy-MM-dd")
    texts = load(spark, d, "events").groupBy("user_id").agg(F.array_join(F.collect_list(day), " and ").alias("text"))
    return texts.select("user_id", F.array_join(ft.dates(F.col("text")), ",").alias("dates"))


@query(r"""WITH s AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)
SELECT doc_id, left(coalesce([x FOR x IN s IF length(x) >= 20][1], text), 200) AS sentence FROM s""")
def p13_first_sentence(spark, d):
    return load(spark, d, "documents").select("doc_id", ft.first_sentence(F.col("text")).alias("sentence"))


@query("SELECT doc_id, array_to_string([x FOR x IN [CASE WHEN regexp_matches(text, '(^|\\W)the ') THEN 'en' END, CASE WHEN regexp_matches(text, ' (les|des) ') THEN 'fr' END, CASE WHEN regexp_matches(text, ' (der|und) ') THEN 'de' END] IF x IS NOT NULL], ',') AS langs FROM documents")
def p14_languages(spark, d):
    found = ft.languages(F.col("text"), {"en": r"(^|\W)the ", "fr": " (les|des) ", "de": " (der|und) "})
    return load(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("langs"))


@query("SELECT o_orderkey, CASE WHEN length(o_orderpriority) >= length(c_mktsegment) THEN o_orderpriority ELSE c_mktsegment END AS longest FROM orders JOIN customer ON o_custkey = c_custkey")
def p15_longest(spark, d):
    orders, customer = load(spark, d, "orders", "customer")
    both = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return both.select("o_orderkey", ft.longest(F.col("o_orderpriority"), F.lit("  "), F.col("c_mktsegment"), F.lit(None).cast("string")).alias("longest"))


@query("SELECT p_partkey, NOT contains(lower(p_name), 'small') AND contains(lower(p_name), 'ring') AND p_size % 2 = 0 AS wanted FROM part")
def p16_wanted_images(spark, d):
    url = F.concat(F.lit("https://x.example/"), F.regexp_replace("p_name", " ", "-"), F.when(F.col("p_size") % 2 == 0, F.lit(".jpg")).otherwise(F.lit(".SVG")))
    return load(spark, d, "part").select("p_partkey", web.wanted_image(url, ["small"], ["ring"]).alias("wanted"))


@query("SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'Event ' || page_id END AS name FROM pages")
def p17_json_ld(spark, d):
    n = F.col("page_id").cast("string")

    def block(text):
        return F.concat(F.lit('<script type="application/ld+json">'), text, F.lit("</script>"))

    event = F.concat(F.lit('{"@type": "MusicEvent", "name": "Event '), n, F.lit('"}'))
    page = F.concat(block(F.lit("{broken")), F.when(F.col("page_id") % 3 == 0, block(event)).when(F.col("page_id") % 3 == 1, block(F.concat(F.lit('{"@graph": [{"@type": "Place"}, '), event, F.lit("]}")))).otherwise(block(F.lit('{"@type": "Place"}'))))
    blocks = load(spark, d, "pages").select("page_id", web.json_ld(page).alias("b"))
    names = F.filter(F.transform("b", lambda x: F.try_variant_get(web.first_event(x), "$.name", "string")), lambda x: x.isNotNull())
    return blocks.select("page_id", F.get(names, F.lit(0)).alias("name"))


@query("SELECT page_id, len(string_split(html, '<li>')) - 1 AS items FROM pages")
def p18_nav_items(spark, d):
    page = F.concat(F.lit("<h2>What is Included</h2><p>x</p>"), F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1), F.lit("<ul><li>other</li></ul>"))
    return load(spark, d, "pages").select("page_id", F.size(web.heading_list(page, "included")).cast("long").alias("items"))


@query(r"""WITH n AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a[^>]*>([^<]*)</a>', 1)) AS item FROM pages)
SELECT page_id, 'included' AS label, 'What is included' AS heading, item FROM n WHERE length(item) >= 2
UNION ALL SELECT page_id, 'extra', 'Not included: paid apart', 'Other thing' FROM pages""")
def p18_services(spark, d):
    """Lists after every matching heading, with their labels; pages get such headings, as the tables have none."""
    nav = F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1)
    more = "<h3>Not included: <i>paid</i> apart</h3><p>y</p><ol><li>Other <b>thing</b><li>x</ol><h2>About</h2><ul><li>no</li></ul><h4>Also included</h4><p>1<p>2<p>3<p>4<p>5<ul><li>too far</li></ul>"
    page = F.concat(F.lit("<h2>What is included</h2><p>x</p>"), nav, F.lit(more))
    return load(spark, d, "pages").select("page_id", F.explode(web.headed_lists(page, "included", "not included|apart")).alias("x")).select("page_id", "x.*")


@query("""WITH d AS (SELECT conv_id, seen, regexp_replace(string_agg(CASE role WHEN 'assistant' THEN regexp_replace(text, '^Day', 'day') ELSE '' END, ' | ' ORDER BY turn) FILTER (role <> 'user'), '^( \\| )+', '') AS text
FROM (SELECT *, sum(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS seen FROM conversations) WHERE seen > 0 GROUP BY conv_id, seen)
SELECT conv_id, count(*) AS days, CAST(nullif(sum(length(replace(left(coalesce(text, ''), 4000), ' | ', ''))), 0) AS BIGINT) AS chars FROM d GROUP BY conv_id""")
def p19_day_groups(spark, d):
    line = F.when(F.col("role") == "user", F.concat(F.lit("Day "), F.col("turn").cast("string"))).when(F.col("role") == "assistant", F.regexp_replace("text", "^Day", "day")).otherwise(F.lit(""))
    turns = load(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    groups = turns.select("conv_id", web.day_groups(F.col("lines"), r"^Day \d+$").alias("days")).where(F.size("days") > 0)
    chars = F.aggregate("days", F.lit(0).cast("long"), lambda n, x: n + F.length(F.regexp_replace(x["text"], r" \| ", "")))
    return groups.select("conv_id", F.size("days").cast("long").alias("days"), F.nullif(chars, F.lit(0).cast("long")).alias("chars"))


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag || ':' || l_linestatus)), ',') AS services FROM lineitem GROUP BY l_orderkey")
def p20_services(spark, d):
    lines = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_returnflag", "l_linestatus"))).alias("s"))
    return lines.select("l_orderkey", F.array_join(F.array_distinct(F.transform("s", lambda x: F.concat_ws(":", x["l_returnflag"], x["l_linestatus"]))), ",").alias("services"))


@query("SELECT o_orderkey, i AS place, CASE i WHEN 1 THEN o_orderpriority WHEN 2 THEN o_orderstatus ELSE 'actor ' || o_custkey END AS name FROM orders CROSS JOIN (VALUES (1), (2), (3)) t(i)")
def p21_running_order(spark, d):
    people = F.concat(F.array("o_orderpriority"), F.array("o_orderstatus"), F.array(F.concat(F.lit("actor "), F.col("o_custkey").cast("string"))))
    return load(spark, d, "orders").select("o_orderkey", F.posexplode(people).alias("i", "name")).select("o_orderkey", (F.col("i") + 1).alias("place"), "name")


@query("SELECT page_id, 'p_' || page_id || '_' || i AS image_id, CASE i WHEN 0 THEN 'cover' ELSE 'gallery' END AS role FROM pages CROSS JOIN (VALUES (0), (1), (2), (3)) t(i)")
def p22_images(spark, d):
    urls = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.lit("https://x.example/"), i.cast("string")))
    card = F.concat(F.lit("p_"), F.col("page_id").cast("string"))
    return load(spark, d, "pages").select("page_id", F.explode(web.image_entries(card, urls)).alias("x")).select("page_id", "x.image_id", "x.role")


@query("SELECT doc_id, array_to_string([x FOR x IN [CASE WHEN length(text) < 60 THEN 'short description' END, CASE WHEN doc_id % 10 = 0 THEN 'no images' END] IF x IS NOT NULL], ';') AS warnings FROM documents")
def p23_warnings(spark, d):
    from ..operators.validation import errors

    found = errors({"short description": F.length("text") >= 60, "no images": F.col("doc_id") % 10 > 0})
    return load(spark, d, "documents").select("doc_id", F.array_join(found, ";").alias("warnings"))


@query(r"""SELECT doc_id, CASE WHEN length(line) <= 200 THEN line WHEN strpos(left(line, 200), ' ') > 1 THEN regexp_replace(left(line, 200), ' [^ ]*$', '') ELSE left(line, 200) END AS description FROM (SELECT doc_id, trim(string_split(text, chr(10))[1]) AS line FROM documents)""")
def p24_short_desc(spark, d):
    return load(spark, d, "documents").select("doc_id", ft.short_description(F.col("text")).alias("description"))


_TOKENS = r"[x FOR x IN regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}\s]+', ' ', 'g'), '\s+') IF x <> '']"


@query(f"SELECT doc_id, CAST(len(t) AS INT) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def p27_tokens(spark, d):
    t = load(spark, d, "documents").select("doc_id", ft.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"SELECT doc_id, CASE WHEN len(t) >= 5 THEN CAST(len(list_distinct([array_to_string(t[i:i + 4], ' ') FOR i IN range(1, len(t) - 3)])) AS INT) ELSE 0 END AS n FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def p28_shingle_count(spark, d):
    return load(spark, d, "documents").select("doc_id", F.size(ft.shingles(ft.tokens(F.col("text")))).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'hint' ELSE p_type || ':' || array_to_string(string_split(lower(p_name || ' of four words'), ' ')[1:3], ' ') END AS topic FROM part")
def p29_topic_key(spark, d):
    hint = F.when(F.col("p_partkey") % 3 == 0, F.lit(" Hint ")).when(F.col("p_partkey") % 3 == 1, F.lit(""))
    return load(spark, d, "part").select("p_partkey", ft.topic_key(hint, F.col("p_type"), F.concat("p_name", F.lit(" of four words"))).alias("topic"))


@query("SELECT n_nationkey, 'synth_txt' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '_' || lpad(CAST(n_regionkey AS VARCHAR), 3, '0') AS id FROM nation")
def p30_known_ids(spark, d):
    rule = F.concat(F.lit("TXT-"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    return load(spark, d, "nation").select("n_nationkey", ft.known_id(rule, F.col("n_regionkey")).alias("id"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'image/png' END AS mime, CASE WHEN doc_id % 2 = 0 THEN lang END AS decoded FROM documents")
def p31_data_url(spark, d):
    url = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("lang").cast("binary")))).otherwise(F.lit("https://x.example/a.png"))
    return load(spark, d, "documents").select("doc_id", ft.data_url(url).alias("u")).select("doc_id", F.col("u.mime").alias("mime"), F.unbase64("u.base64").cast("string").alias("decoded"))


@query("SELECT page_id, sha1(url) AS cache_key, sha256(html) AS content FROM pages")
def p32_content_keys(spark, d):
    return load(spark, d, "pages").select("page_id", F.sha1(F.col("url").cast("binary")).alias("cache_key"), F.sha2(F.col("html").cast("binary"), 256).alias("content"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '…' ELSE text END AS cut FROM documents")
def p33_truncate(spark, d):
    return load(spark, d, "documents").select("doc_id", ft.truncated(F.col("text")).alias("cut"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END AS number FROM events")
def p34_number(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return load(spark, d, "events").select("event_id", ft.number_or_zero(raw).alias("number"))


@query("SELECT event_id, list_extract(['png', 'jpg', 'webp', 'jpg'], CAST(event_id % 4 AS INT) + 1) AS ext FROM events")
def p35_extension(spark, d):
    mime = F.element_at(F.array(*map(F.lit, ("Image/PNG; q=1", "image/jpeg", " image/webp ", "text/x-none"))), (F.col("event_id") % 4 + 1).cast("int"))
    return load(spark, d, "events").select("event_id", ft.extension(mime).alias("ext"))
