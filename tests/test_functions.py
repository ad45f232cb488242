"""Text, page, source, merge and provider functions on hand-sized tables."""

import pytest
from pyspark.sql import functions as F

from cardamom.functions import text as ft
from cardamom.functions import web
from cardamom.operators import audit, joins, merge, metrics, provider, sampling, validation


def one(spark, value, *, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}")


def result(spark, value, f, kind="string"):
    return one(spark, value, kind=kind).select(f(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(("raw", "want"), [("1 час 30 минут", 90), ("2,5 часа", 150), ("3 дня", 4320), ("нет", None), ("45 мин", 45)])
def test_duration(spark, raw, want):
    assert result(spark, raw, ft.duration_minutes) == want


@pytest.mark.parametrize(("raw", "want"), [("от 2 до 8", (2, 8)), ("группа До 15", (None, 15)), ("", None)])
def test_group_size(spark, raw, want):
    got = result(spark, raw, ft.group_size)
    assert (tuple(got) if got else None) == want


def test_short_description(spark):
    long = "word " * 50
    assert result(spark, f"{long}\nsecond", ft.short_description) == ("word " * 40).strip()
    assert result(spark, "x" * 201, ft.short_description) == "x" * 200
    assert result(spark, "first \nsecond", ft.short_description) == "first"
    assert result(spark, "", ft.short_description) == ""


@pytest.mark.parametrize(("n", "want"), [(0, 0), (4, 0), (5, 1), (6, 2)])
def test_shingles_of_short_texts(spark, n, want):
    assert len(result(spark, " ".join(f"w{i}" for i in range(n)), lambda c: ft.shingles(ft.tokens(c)))) == want


def test_normalise_and_tokens(spark):
    assert result(spark, " a  b \n\n\n\nc ", ft.normalise) == "a b\nc"
    assert result(spark, None, ft.normalise) == ""
    assert result(spark, "Don't_stop, ÉTÉ 12!", ft.tokens) == ["don", "t", "stop", "été", "12"]
    assert result(spark, "a😀", ft.utf16_length) == 3


def test_first_sentence_and_dates(spark):
    assert result(spark, "Short. This one is long enough! Third.", ft.first_sentence) == "This one is long enough!"
    assert result(spark, "on 2024-05-02, 2024-05-01 and 2024-05-02", ft.dates) == ["2024-05-01", "2024-05-02"]


def test_data_url_and_extension(spark):
    assert tuple(result(spark, "data:image/png;base64,QQ==", ft.data_url)) == ("image/png", "QQ==")
    assert result(spark, "https://x", ft.data_url) is None
    assert result(spark, "IMAGE/WEBP; q=1", ft.extension) == "webp" and result(spark, "text/x", ft.extension) == "jpg"


def test_absolute_urls(spark):
    df = spark.createDataFrame([("https://a.b/c/d", "../e"), ("https://a.b/", "http://x.y/z"), ("https://a.b/", None), ("", "rel")], "base string, href string")
    assert [r[0] for r in df.select(web.absolute_url("base", "href")).collect()] == ["https://a.b/e", "http://x.y/z", None, None]


def test_heading_list(spark):
    page = "<h2>Other</h2><ul><li>no</li></ul><h3>What is included</h3><p>text</p><ul><li>one<li> two <b>b</b><ul><li>deep</ul></ul><ul><li>later</ul>"
    got = one(spark, page).select(web.heading_list(F.col("c"), "INCLUDED").alias("r")).first()["r"]
    assert got[0] == "one" and got[1].startswith("two b") and "later" not in got and "no" not in got


def test_day_groups(spark):
    got = result(spark, ["before", "Day 1", "a", "b", "Day 2", "Day 3", "c"], lambda c: web.day_groups(c, r"^Day \d+$"), "array<string>")
    assert [tuple(x) for x in got] == [("Day 1", "a | b"), ("Day 2", ""), ("Day 3", "c")]


def test_json_ld_skips_broken_blocks(spark):
    page = '<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph": [{"@type": "Place"}, {"@type": "MusicEvent", "name": "n"}]}</script>'
    assert result(spark, page, lambda c: F.try_variant_get(web.first_event(F.get(web.json_ld(c), F.lit(0))), "$.name", "string")) == "n"


def test_prefix_of_longest_key(spark):
    calls = spark.createDataFrame([("a-2-max:1.0",), ("a-20",), ("b-lite",), ("zzz",), (None,)], "model string")
    prices = spark.createDataFrame([("a", 1.0), ("a-2", 2.0), ("a-2-max", 3.0), ("b", 4.0)], "price_key string, rate double")
    got = {r["model"]: r["price_key"] for r in joins.longest_prefix(calls, prices, "model", "price_key").collect()}
    assert got == {"a-2-max:1.0": "a-2-max", "a-20": "a", "b-lite": "b", "zzz": None, None: None}
    assert {r["model"]: r["price_key"] for r in joins.longest_prefix(calls, prices, "model", "price_key", ":").collect()}["b-lite"] is None


def test_prices_overridden(spark):
    calls = spark.createDataFrame([("a",), ("z",)], "model string")
    prices = spark.createDataFrame([("a", 1.0, 2.0)], "price_key string, p double, c double")
    assert [tuple(r) for r in provider.priced(calls, prices, "model", ["p", "c"], {"c": 9.0}).orderBy("model").collect()] == [("a", "a", 1.0, 9.0), ("z", None, 0.0, 9.0)]


@pytest.mark.parametrize(("attempt", "after", "jitter", "want"), [(0, 5, 0.5, 5000), (0, -1, 0.5, 1000), (10, None, 0.5, 30000), (2, None, 0.5, 4000), (1, 100, 0.0, 30000)])
def test_backoff(spark, attempt, after, jitter, want):
    df = spark.createDataFrame([(attempt, after, jitter)], "a int, r int, j double")
    assert df.select(provider.backoff(F.col("a"), F.col("r"), F.col("j"))).first()[0] == want


def test_messages(spark):
    raw = ["plain", '[{"role": "x", "content": "a"}]', '{"messages": []}', "{broken", '[{"role": "system", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "image_url", "image_url": {"url": "data:image/png;base64,QQ=="}}]}, 5]', '"text"']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = [r[0] for r in df.orderBy("i").select(provider.messages(F.col("raw"))).collect()]
    assert [[(m["role"], m["text"]) for m in g] for g in got] == [[("user", "plain")], [("user", "a")], [], [("user", "{broken")], [("system", "a\n\nb")], [("user", '"text"')]]
    assert got[4][0]["images"][0]["mime"] == "image/png"


@pytest.mark.parametrize(("s", "want"), [(["critical"], "reject"), (["high", "low"], "reject"), (["medium"], "needs_review"), (["low"], "approve"), ([], "approve")])
def test_verdict(spark, s, want):
    assert result(spark, s, metrics.verdict, "array<string>") == want


def test_gap_keeps_null(spark):
    df = spark.createDataFrame([(None, 3), (0, 3), (5, 3), (5, 9)], "q int, t int")
    assert [r[0] for r in df.select(audit.gap(F.col("q"), F.col("t"))).collect()] == [None, 0, 2, 0]


def test_percentiles_are_the_elements_at_floor(spark):
    df = spark.range(1, 21).select(F.lit("g").alias("g"), F.col("id").alias("v")).union(spark.createDataFrame([("g", 0)], "g string, v long"))
    r = audit.percentile_bounds(df, ["g"], "v").first()
    assert (r["n"], r["p_low"], r["p_high"]) == (20, 2, 20)


def test_diversity(spark):
    rows = [("four", "k")] * 4 + [("five", "k")] * 5 + [("two", k) for k in "aabbb"]
    got = {r["g"]: (r["ratio"], r["warning"]) for r in validation.diversity(spark.createDataFrame(rows, "g string, k string"), ["g"], "k").collect()}
    assert got == {"four": (1.0, False), "five": (0.2, True), "two": (0.4, False)}


def test_quotes_at_paths(spark):
    cards = spark.createDataFrame([(1, ("t", [("one", "x"), (None, "y")]))], "id int, card struct<title: string, items: array<struct<a: string, b: string>>>")
    leaves = validation.flatten(cards, "card", ["id"])
    assert sorted((r["path"], r["text"]) for r in leaves.collect()) == [("items[0].a", "one"), ("items[0].b", "x"), ("items[1].b", "y"), ("title", "t")]
    claims = spark.createDataFrame([(1, "items[0].a", "on"), (1, "items[5].a", "on"), (1, "items", "on"), (1, "title", ""), (1, "none", "t")], "id int, path string, quote string")
    assert {r["path"]: r["found"] for r in validation.quoted(claims, leaves, "id").collect()} == {"items[0].a": True, "items[5].a": False, "items": False, "title": False, "none": False}


def test_merges(spark):
    store = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, seq int")
    batch = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, None, 1)], "id int, v string, seq int")
    assert sorted(tuple(r) for r in merge.upsert(store, batch, "id", "seq").collect()) == [(1, "a", 0), (2, "d", 2), (3, None, 1)]
    assert sorted((r["id"], r["v"], r["status"]) for r in merge.append_status(batch, store, "id", "seq").collect() if r["v"]) == [(2, "c", "error"), (2, "d", "error")]
    old = spark.createDataFrame([(1, "a", "clean"), (2, "b", "clean"), (3, "c", "clean"), (4, "d", "clean")], "id int, v string, p string")
    new = spark.createDataFrame([(1, "a", "clean"), (2, "x", "clean"), (3, "c", "dirty"), (5, "e", "clean")], "id int, v string, p string")
    assert {r["id"]: r["change"] for r in merge.change_flags(old, new, "id", ["v"], "p").collect()} == {1: "none", 2: "U", 3: "M", 4: "D", 5: "I"}


def test_near_duplicates_strictly_above(spark):
    base = [f"w{i}" for i in range(21)]  # 17 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base[:18])), (4, ""), (5, None), (6, "few words"), (7, "few words")]
    got = {(r["a"], r["b"]): r["similarity"] for r in joins.near_duplicates(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()}
    assert got == {(1, 2): 1.0, (1, 3): 14 / 17, (2, 3): 14 / 17}
    exact = [(1, " ".join(f"v{i}" for i in range(14))), (2, " ".join(f"v{i}" for i in range(11)))]  # 7 of 10
    assert joins.near_duplicates(spark.createDataFrame(exact, "id int, t string"), "id", "t").count() == 0


def test_samples_are_stable(spark):
    rows = spark.range(100).withColumn("s", F.col("id") % 3)
    order = [sampling.shuffled(F.col("id"), 42), "id"]
    one, two = (sorted(r["id"] for r in sampling.sample(x, order, 10).collect()) for x in (rows, rows.repartition(7)))
    assert one == two and len(one) == 10
    assert {r["s"]: r["n"] for r in sampling.least_per_stratum(rows, "s", 3, 20, order).where("first").groupBy("s").agg(F.count("*").alias("n")).collect()} == {0: 3, 1: 3, 2: 3}


def test_retries_of_responses_and_connections(spark):
    df = spark.createDataFrame([(s,) for s in (200, 400, 404, 429, 500, 503, 504, 599, 600, None)], "s int")
    assert [r[0] for r in df.where(provider.retryable(F.col("s"))).collect()] == [429, 500, 503, 504, 599]
    assert [r[0] for r in df.where(provider.retryable(F.col("s"), (429, 503), server_errors=False)).collect()] == [429, 503]
    cases = [
        ("EAI_AGAIN", None, "Error", "x", True), (None, "UND_ERR_BODY_TIMEOUT", "TypeError", "terminated", True), ("EPERM", "ENOTFOUND", "Error", None, True), ("EPERM", "EPERM", "Error", "network timeout", False),
        (None, None, "TypeError", "Fetch Failed", True), (None, None, "Error", "fetch failed", False), (None, None, "AbortError", None, True), (None, None, "TimeoutError", "", True), (None, None, None, None, False),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, code string, cause string, name string, message string")
    got = df.orderBy("i").select(provider.broken_connection(F.col("code"), F.col("cause"), F.col("name"), F.col("message"))).collect()
    assert [r[0] for r in got] == [c[4] for c in cases]


@pytest.mark.parametrize(("header", "want"), [("2", 2.0), (" 1.5 ", 1.5), ("0", 0.0), ("", 0.0), ("-1", None), ("Wed, 21 Oct 2015 07:28:00 GMT", None), ("NaN", None), ("Infinity", None), (None, None)])
def test_retry_after(spark, header, want):
    assert one(spark, header).select(provider.retry_after(F.col("c"))).first()[0] == want


def test_tokens_serve_until_two_minutes_before_their_end(spark):
    calls = [(i, "a", t) for i, t in enumerate([0, 10, 1689, 1690, 3000, 3379, 3380])] + [(90, "b", 20), (91, None, 20), (92, "a", None)]
    tokens = [("a", 10), ("a", 1700), ("a", 10), (None, 5)]
    df = spark.createDataFrame(calls, "i int, owner string, t long").withColumn("t", F.timestamp_seconds("t"))
    issued = spark.createDataFrame(tokens, "owner string, t long").select("owner", F.timestamp_seconds("t").alias("issued"))
    got = {r["i"]: r["s"] for r in provider.with_tokens(df, issued, "owner", "t", 1800).select("i", F.unix_seconds("issued").alias("s")).collect()}
    assert got == {0: None, 1: 10, 2: 10, 3: None, 4: 1700, 5: 1700, 6: None, 90: None, 91: None, 92: None}


def test_file_ids_last_a_day(spark):
    def at(hours):
        return F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(hours))

    cache = spark.range(1).select(F.lit("x").alias("content"), F.lit("old").alias("file_id"), at(0).alias("uploaded_at")).union(spark.range(1).select(F.lit("x"), F.lit("new"), at(5)))
    uploads = spark.createDataFrame([(0, "x", 24), (1, "x", 29), (2, "x", 30), (3, "y", 1), (4, None, 1)], "i int, content string, h int").withColumn("at", F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("h")))
    assert {r["i"]: r["file_id"] for r in provider.file_ids(uploads, cache, "content", "at").collect()} == {0: "new", 1: "new", 2: None, 3: None, 4: None}


def test_numbers_of_a_large_group(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 < 8, F.lit("hot")).when(F.col("id") % 10 == 8, F.concat(F.lit("k"), F.col("id"))).alias("g"))
    got = sampling.numbered(rows, "g", F.lit(3), ["id"]).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r["id"]):
        seen[r["g"]] = seen.get(r["g"], 3) + 1
        assert r["number"] == seen[r["g"]]
    assert len(got) == 3000 and seen["hot"] == 2403 and seen[None] == 303


def test_lists_after_every_heading(spark):
    page = """<h1>Included</h1><ul><li>no</li></ul><div><h2>What is <b>included</b></h2>text<p>x<ul><li>one<li>two <i>and</i>
     <ol><li>inner</li></ol></li><li>z</li></ul><ul><li>second list</li></ul></div>
     <h3>NOT included</h3><div><ul><li>in a div</li></ul></div><ol><li>paid &amp; extra</li></ol><h4>Included too</h4><p>1</p><p>2</p><p>3</p><p>4</p><p>5</p><ul><li>far</li></ul><h2>Included last"""
    df = spark.createDataFrame([(page,), (None,), ("",), ("<h2>included</h2>",)], "c string")
    got = [[tuple(x) for x in r["r"]] for r in df.select(web.headed_lists(F.col("c"), "included", "not").alias("r")).collect()]
    first = "What is included"
    assert got[0] == [("included", first, "one"), ("included", first, "two and inner"), ("included", first, "inner"), ("extra", "NOT included", "paid & extra")]
    assert got[1:] == [[], [], []]


def test_links_of_near_duplicates_count_copies(spark):
    from collections import Counter

    base = [f"w{i}" for i in range(40)]
    near = [*base[:-1], "other"]
    rows = [(i, " ".join(base)) for i in range(300)] + [(i, " ".join(near)) for i in range(300, 350)] + [(900, "one two three four five six"), (901, "too short"), (902, None), (903, "")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r["id"]: (r["class"], r["links"]) for r in joins.near_duplicate_links(df, "id", "t").collect()}
    assert len(got) == len(rows)
    assert all(got[i] == (0, 349) for i in range(300)) and all(got[i] == (300, 349) for i in range(300, 350))
    assert got[900] == (900, 0) and all(got[i] == (None, 0) for i in (901, 902, 903))
    some = df.where("id between 290 and 310")
    ends = Counter(x for r in joins.near_duplicates(some, "id", "t").collect() for x in (r["a"], r["b"]))
    assert {r["id"]: r["links"] for r in joins.near_duplicate_links(some, "id", "t").collect()} == dict(ends)
    assert joins.near_duplicate_links(df.limit(0), "id", "t").count() == 0
