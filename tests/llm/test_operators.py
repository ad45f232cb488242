"""Operators and queries on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cardamom.llm import bpe, decontaminate, htmltext, language, mtree, neardup, privacy, queries, substring, tokencount, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["id", "rep", "h", "v", "doc", "first", "a", "b", "spans", "hits", "items", "class", "sig", "__text", "n_words", "keep", "added", "q"]


def words(seed, n):
    out, x = [], seed
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(f"w{x // 65536 % 5000}")
    return out


def documents():
    """Texts of every awkward kind, with passages and copies."""
    base, other, passage = words(1, 300), words(2, 200), words(3, 70)
    near = base[:100] + ["changed"] + base[101:]
    texts = [
        None, "", " \n\t", "one", "two words", " ".join(base), " ".join(near), " ".join(base), " ".join(other[:80] + passage + other[80:]), " ".join(words(4, 90) + passage + words(5, 40)),
        "  ".join(words(6, 20) + passage), " ".join(passage[:49]), " ".join(passage[:50]), "x " * 400, "x " * 300, "é" * 5000, " ".join(words(7, 6000)), "one", "ONE",
        " ".join(near[:200] + ["again"] + near[201:]), "a b c d e", "a b c d e f", " ".join(base[:60]),
    ]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = documents()
    return spark.createDataFrame(rows + [rows[5], rows[8], (None, "one"), (None, None)], "doc_id long, text string")


def with_clashes(df):
    return df.withColumns({c: F.lit(1) for c in CLASH})


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def brute_repeats(rows, n=50):
    first = {}
    for i, t in rows:
        if i is not None:
            w = (t or "").encode().split()
            for k in range(len(w) - n + 1):
                key = tuple(w[k : k + n])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        if i is not None:
            for k in range(len(w) - n + 1):
                if first[tuple(w[k : k + n])] < i:
                    gone.update(range(k, k + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept.decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("anchors", "shard_words", "block_words", "task_bytes"), [(2_000_000, 100_000, 20_000, 16 << 20), (0, 100, 40, 300)])
def test_substring_dedup(docs, monkeypatch, anchors, shard_words, block_words, task_bytes):
    monkeypatch.setattr(substring, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(substring, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(substring, "TASK_BYTES", task_bytes)
    monkeypatch.setattr(substring, "HOT", 5000 if anchors else 2)
    rows = [tuple(r) for r in docs.collect()]
    got = substring.remove_repeats(with_clashes(docs), broadcast_anchors=anchors)
    assert collected(got, "doc_id", "n_words", "n_removed", "kept") == brute_repeats(rows)
    assert sum(r[2] for r in brute_repeats(rows)) > 500


def test_runs_of_windows(spark):
    at = [[0], [0, 1, 2], [0, 5, 6, 12], [3, 3, 8], [], [0, 6]]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(at)], "i int, at array<int>")
    got = [[tuple(x) for x in r[0]] for r in df.orderBy("i").select(substring._runs("at", 5)).collect()]
    assert got == [[(0, 5)], [(0, 7)], [(0, 11), (12, 17)], [(3, 13)], [], [(0, 5), (6, 11)]]


def brute_components(rows, n=5):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if i is not None:
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_duplicates(docs):
    rows = [tuple(r) for r in docs.collect()]
    want = brute_components(rows)
    got = neardup.find_components(with_clashes(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
        else:
            assert not r["kept"]
    assert any(c != i for i, (_, c) in want.items())


def test_near_duplicates_link_through_the_second_round(spark):
    # 0 and 1 share lists with 2 and 3 without being similar to them; 2 and 3 are
    base = words(11, 200)
    rows = [(0, base[:120] + words(12, 80)), (1, base[:110] + words(13, 90)), (2, base), (3, base[:190] + words(14, 10)), (4, base[:185] + words(15, 15))]
    rows = [(i, " ".join(w)) for i, w in rows]
    got = {r["doc_id"]: r["component_id"] for r in neardup.find_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()}


@pytest.mark.parametrize("meeting", [1000, 2])
def test_near_duplicates_link_through_the_last_round(spark, monkeypatch, meeting):
    """Posting lists of more members than leaders, of several components, whose links only the shingles themselves find."""
    monkeypatch.setattr(neardup, "MEETING", meeting)
    rounds = []
    last = neardup._last_round
    monkeypatch.setattr(neardup, "_last_round", lambda left, *args: rounds.append(left.count()) or last(left, *args))
    shared, rows = words(71, 100), []
    for k in range(30):
        own = words(100 + k, 60)
        rows += [(10 * k + v, shared + own[: 60 - 4 * v] + words(500 + 10 * k + v, 4 * v)) for v in range(3)]
    rows = [(i, " ".join(w)) for i, w in rows] + [(1000 + k, " ".join(shared + words(900 + k, 33))) for k in range(8)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.find_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: c for i, (_, c) in brute_components(rows).items()}
    assert got == want and rounds and rounds[0] > neardup.LEADERS + 1
    assert 10 < len(set(want.values())) < len(rows) - 10


def brute_contamination(rows, items, n=13):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def split(t):
        return pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    wins = {}
    for item, t in items:
        w = split(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).update([] if item is None else [str(item)])
    out = []
    for i, t in rows:
        w, hit, met = split(t), set(), set()
        for m in {len(x) for x in wins}:
            for k in range(len(w) - m + 1):
                if (ids := wins.get(tuple(w[k : k + m]))) is not None:
                    hit.update(range(k, k + m))
                    met |= ids
        out.append((i, len(w), len(hit), sorted(met)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chars", [10**6, 120])
def test_contamination(spark, chars):
    item = " ".join(words(21, 30))
    items = [(1, item), (2, "Two short, words"), (3, None), (4, ""), (None, "null id item here"), (10, item), (11, "one")]
    rows = [(i, t) for i, t in documents()[:12]] + [(100, f"pre {item[20:]} post"), (101, "TWO short words two SHORT-words!"), (102, "is a null id item here"), (103, "One"), (None, "one")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(with_clashes(docs), with_clashes(bench), item_chars=chars)
    assert collected(got, "doc_id", "n_words", "n_hit", "items") == brute_contamination(rows, items)


def test_passages_leave_kept_documents(spark, tmp_path):
    import corpus_pipeline

    item, own = words(51, 13), ["Été", "—", "naïve", *words(52, 300)]
    passage = ", ".join(item).upper()
    rows = [(1, f"{' '.join(own[:150])}. {passage}; {' '.join(own[150:])}!", "en", "s", 0), (2, "É. " + " ".join(own) + " end.", "en", "s", 7), (3, " ".join(item) + " end", "en", "s", 0), (4, None, None, None, None), (5, f"{' '.join(own)} {passage}.", "en", "s", 0)]
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 4, 5}
    assert got[1]["text"] == f"{' '.join(own[:150])}; {' '.join(own[150:])}!" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[5]["text"] == " ".join(own) + "." and got[2]["text"] == rows[1][1] and got[2]["n_chars"] == 7 and got[4]["text"] is None
    again = decontaminate.find_contamination(spark.createDataFrame(list(got.values()), docs.schema), spark.read.parquet(str(tmp_path / "benchmark.parquet")))
    assert again.where("n_hit > 0").count() == 0


def test_bpe_rows(spark, docs):
    data, pattern = queries.byte_vocabulary()
    coder = bpe.ByteBPE(bpe.read_ranks(data), pattern)
    got = bpe.encode_documents(with_clashes(docs).withColumn("n_tokens", F.lit("x")), data, pattern, keep=["doc_id", "n_tokens"])
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    rows = got.collect()
    texts = {i: t or "" for i, t in documents()}
    for r in rows:
        if r["doc_id"] is not None:
            ids = coder._core.encode_ordinary(texts[r["doc_id"]])
            assert bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in ids) and r["n_tokens"] == len(ids)
            assert bytes(r["decoded"]).decode() == texts[r["doc_id"]]
    assert len(rows) == docs.count()


@pytest.mark.parametrize("few", [20_000, 1])
def test_topk(spark, monkeypatch, few):
    monkeypatch.setattr(mtree, "FEW_QUERIES", few)
    vectors = [(i, [float((i * 7 + j * 3) % 11) / 10 - 0.5 for j in range(4)]) for i in range(90)]
    vectors += [vectors[3], (200, None), (220, [1.0, None, 0.0, 0.0]), (240, [float("nan")] * 4), (260, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.0] * 4), (280, [0.1, 0.2]), (281, [0.3, 0.2]), (300, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    whole = with_clashes(df).select("vec_id", "h", mtree.whole_vectors(df, "embedding").alias("v"))
    got = mtree.top_k(whole, F.pmod("vec_id", F.lit(20)) == 0, k=5, shard_rows=20, task_queries=3)
    import math

    clean = {i: [math.floor(64 * x) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in clean:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(clean[q], v, strict=True)), i) for i, v in clean.items() if i != q and len(v) == len(clean[q]))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert collected(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_topk_of_clusters(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.integers(-60, 60, (30, 6))[rng.integers(0, 30, 900)] + rng.integers(-3, 4, (900, 6))
    x[100:300] = x[7]  # a cell of more than a shard
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<long>")
    got = {}
    for r in mtree.top_k(df, F.col("vec_id") % 20 == 7, k=12, shard_rows=30).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (-r["score"], r["vec_id"])
    assert set(got) == set(range(7, 900, 20))
    for q, found in got.items():
        assert [found[k + 1] for k in range(len(found))] == sorted((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q)[:12]


def test_lines_around_an_article(spark):
    def page(i):
        return f"<html><body><div>Site name</div><main><h1>Title {i}</h1><article><p>Body {i}</p></article><p>tail {i}</p></main><div>All rights reserved</div></body></html>"

    rows = [(i, f"https://h.example/a/{i}", page(i)) for i in range(4)]
    # a teaser that is marked, beside a text that isn't; and a host of one page, which has nothing to compare with
    rows += [(4, "https://h.example/a/4", "<div>Site name</div><div id=content><p>Long main text</p></div><article><h3>Other story</h3></article><div>All rights reserved</div>"), (5, "https://one.example/x", page(5)), (6, None, page(6))]
    got = {r["page_id"]: r for r in htmltext.extract(with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert [got[i]["text"] for i in range(4)] == [f"Title {i}\nBody {i}\ntail {i}" for i in range(4)]
    assert got[4]["text"] == "Long main text\nOther story" and got[5]["text"] == "Body 5" and got[6]["text"] == "Body 6"
    assert {r["decided_by"] for r in got.values()} == {"markup"} and all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    data, pattern = queries.byte_vocabulary()
    assert substring.remove_repeats(docs).count() == 0
    assert neardup.find_components(docs).count() == 0
    assert decontaminate.find_contamination(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert bpe.encode_documents(docs, data, pattern).count() == 0
    edits = docs.withColumn("edits", F.lit(None).cast("array<struct<start: int, end: int, text: string>>"))
    assert tokencount.count_edited(edits, data, pattern).count() == 0
    assert privacy.extract(docs).count() == 0 and privacy.redact(docs).count() == 0
    assert language.identify(docs, language.fit(docs, ~language.held_out())).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels, {"toxic": F.col("toxic")})).count() == 0
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert mtree.top_k(spark.createDataFrame([], "vec_id long, v array<long>"), F.col("vec_id") == 0).count() == 0


def test_personal_data_is_bootstrapped(spark):
    rows = [(i, f"w{i} contact telephone +1 (743) 555-38{i:02d} bye") for i in range(12)]
    rows += [(50, "please contact telephone 5551234-99 now"), (51, "code 5551234-77 alone"), (52, None), (53, ""), (None, "write a@b.co"), (54, "ip 10.0.0.1, x@y.zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = {r["doc_id"]: r for r in privacy.extract(with_clashes(docs)).collect()}
    assert [tuple(s) for s in got[50]["spans"]] == [("phone", 25, 35)] and got[50]["base"] == []
    assert got[51]["spans"] == [] and got[52]["spans"] == [] and got[53]["spans"] == []
    assert [s["kind"] for s in got[54]["spans"]] == ["email", "ip"]
    masked = {r["doc_id"]: r for r in privacy.redact(docs.withColumn("extra", F.lit(1))).collect()}
    assert masked[50]["text"] == "please contact telephone [PHONE] now" and masked[50]["n_chars"] == len(masked[50]["text"])
    assert masked[52]["text"] is None and masked[None]["text"] == "write [EMAIL]" and masked[51]["text"] == "code 5551234-77 alone"


def test_pages_of_near_urls(spark):
    def page(body):
        return f"<html><body><div>Site name</div><p>{body}</p><div>All rights reserved</div></body></html>"

    rows = [(i, f"https://h.example/a/{i}", page(f"text {i}")) for i in range(6)]
    rows += [(7, "https://alone.example/x", page("alone")), (8, None, page("no url")), (9, "https://h.example/z", None), (10, "https://h.example/b/0", "<article>Mine</article><p>All rights reserved</p>"), rows[0], (11, "http://[bad", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(with_clashes(pages)).collect()}
    assert [got[i] for i in range(1, 6)] == [f"text {i}" for i in range(1, 6)]
    assert got[7] == "Site name\nalone\nAll rights reserved" and got[8].startswith("Site name") and got[9] == "" and got[10] == "Mine" and got[11] == "x"
    decided = {r["page_id"]: r["decided_by"] for r in htmltext.extract(pages).collect()}
    assert decided[2] == "difference" and decided[10] == "markup" and decided[7] is None and decided[9] is None


def test_copies_of_a_page_keep_their_text(spark):
    def page(body, advert=""):
        return f"<html><body><div>Site name</div><nav>{advert}</nav><p>{body}</p><div>All rights reserved</div></body></html>"

    rows = [(i, f"https://h.example/a/{i}", page(f"text {i}")) for i in range(6)]
    rows += [rows[0], (20, "https://h.example/a/3", page("text 3", "other advert"))]
    # mirrored copies at near URLs, more than a partition has; copies alone on a host
    rows += [(100 + i, f"https://h.example/m/{i:03}", page("mirrored", f"advert {i}")) for i in range(80)]
    rows += [(200 + i, f"https://same.example/{i}", page("same")) for i in range(3)]
    rows += [(300, "https://mark.example/a/1", page("marked")), (301, "https://mark.example/a/1?", "<div>Site name</div><article><p>marked</p></article><div>All rights reserved</div>"), (302, "https://mark.example/b", page("else"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = htmltext.extract(with_clashes(pages)).collect()
    assert sorted(r["text"] for r in got if r["page_id"] in (0, 3, 20)) == ["text 0", "text 0", "text 3", "text 3"]
    texts = {r["page_id"]: r["text"] for r in got}
    assert [texts[i] for i in range(6)] == [f"text {i}" for i in range(6)]
    assert {texts[100 + i] for i in range(80)} == {"mirrored"}
    assert {texts[200 + i] for i in range(3)} == {"Site name\nsame\nAll rights reserved"}
    assert texts[300] == "marked" and texts[301] == "marked"


def near(body, i):
    """A copy of a text with one line changed."""
    return [*body[:i], f"changed line {i} of it", *body[i + 1 :]]


def test_pages_without_an_article(spark):
    """Templates of plain divs on three hosts: the text is what the neighbours don't share, copies of a story keep it."""

    def page(host, lines):
        head = "".join(f"<div>{host} menu entry {k}</div>" for k in range(4))
        return f"<html><body>{head}{''.join(f'<p>{x}</p>' for x in lines)}<div>{host} all rights reserved</div></body></html>"

    rows, want = [], {}
    for h in range(3):
        for i in range(12):
            body = [f"{w} of story {h} {i}" for w in words(60 + 20 * h + i, 3 + i % 5)]
            rows.append((100 * h + i, f"https://h{h}.example/s{i // 4}/{i}", page(h, body)))
            want[100 * h + i] = "\n".join(body)
    story = [f"a long line of one story that two mirrors have, number {k}, with more words in it" for k in range(14)]
    for k in range(30):
        body = near(story, k % 14)
        rows.append((1000 + k, f"https://h1.example/s1/4-{k:02}", page(1, body)))
        want[1000 + k] = "\n".join(body)
    got = {r["page_id"]: r for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert {r["decided_by"] for r in got.values()} == {"difference"}
    # two mirrors of one story and nothing else on the host: none empties the other
    two = [(i, f"https://x.example/a/{i}", page(1, near(story, i))) for i in range(2)]
    got = htmltext.extract(spark.createDataFrame(two, "page_id long, url string, html string")).collect()
    assert all("of one story" in r["text"] for r in got)


def test_short_stories_lose_a_long_menu(spark):
    """Pages that share nearly all of their characters aren't copies if it is the host's menu that they share; near copies among them keep their story."""
    menu = "".join(f"<div>menu entry number {k:02} of the site</div>" for k in range(20))

    def page(*lines):
        return f"<html><body>{menu}{''.join(f'<p>{x}</p>' for x in lines)}</body></html>"

    want = {i: f"Story {i}, in one sentence." for i in range(9)}
    rows = [(i, f"https://h.example/s/{i}", page(t)) for i, t in want.items()]
    rows.append((20, "https://h.example/s/95", page()))
    want[20] = ""
    long = " ".join(["a story of two mirrors"] * 9)
    for k in range(3):
        rows.append((30 + k, f"https://h.example/s/4-{k}", page(long, f"seen {k}")))
        want[30 + k] = f"{long}\nseen {k}"
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in got.collect()} == want


def test_long_pages(spark):
    rows = [(i, f"https://h.example/{i}", f"<div>site</div>{'<p>same</p>' * 4000}" + "".join(f"<p>text {i} {k}</p>" for k in range(4000))) for i in range(2)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join(f"text {i} {k}" for k in range(4000)) for i in range(2)}


def test_language_rows(spark):
    en, fr = "the thing with that other quick story ", "les choses que nous avons toujours vues "
    rows = [(i, (en if i % 2 else fr) * 5, "en" if i % 2 else "fr") for i in range(40)] + [(100, None, "en"), (101, "", None), (102, "123 !", "fr"), (None, en, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(with_clashes(docs), language.fit(docs, ~language.held_out())).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(40))
    assert [got[i]["lang_pred"] for i in (100, 101, 102, None)] == ["und", "und", "und", "en"]


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    near = words(31, 120)
    item = " ".join(words(32, 20))
    rows = [(i, " ".join(words(40 + i, 60)), "en", "s", 0) for i in range(20)]
    rows += [(30, " ".join(near), "en", "s", 0), (31, " ".join(near[:-1] + ["z"]), "en", "s", 0), (32, item + " end", "en", "s", 0), (33, "1234 !", "en", "s", 0), (34, None, None, None, None), (35, "mail me at me@site.example please", "en", "s", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(20), 30, 35}
    data, pattern = queries.byte_vocabulary()
    coder = bpe.ByteBPE(bpe.read_ranks(data), pattern)
    want = coder._core.encode_ordinary("mail me at [EMAIL] please")
    assert bytes(got[35]["ids"]) == b"".join(i.to_bytes(4, "little") for i in want)
    assert got[35]["decoded_sha256"] == hashlib.sha256(b"mail me at [EMAIL] please").hexdigest()


def test_counts_of_awkward_edits(spark, docs):
    data, pattern = queries.byte_vocabulary()
    coder = bpe.ByteBPE(bpe.read_ranks(data), pattern)._core
    kind = "array<struct<start: int, end: int, text: string>>"
    texts = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id is not null").collect()}
    edits = {
        0: None, 1: [], 2: [None], 3: [(0, 1, "two"), (None, None, "all new words")], 4: [(99, 200, " end"), (3, 1, "x")], 5: [(10, 40, None), (None, 5, None), (7, None, "tail")],
        15: [(2500, 2501, "e")], 16: [(1000, 1000, "a b "), None, (0, 30_000, "")],
    }
    rows = [(i, e) for i, e in edits.items()]
    table = with_clashes(docs).join(spark.createDataFrame(rows, f"doc_id long, edits {kind}"), "doc_id", "left").withColumn("n_tokens", F.lit("x"))
    got = tokencount.count_edited(table, data, pattern, keep=["doc_id", "h", "n_tokens"])
    assert got.columns == ["doc_id", "h", "n_tokens", "n_chars_edited", "n_tokens_edited", "n_reencoded"]
    found = got.collect()
    assert len(found) == docs.count()
    for r in found:
        if r["doc_id"] is None:
            continue
        t = now = texts[r["doc_id"]]
        for e in edits.get(r["doc_id"]) or ():
            if e is not None:
                a = min(e[0] or 0, len(now))
                b = min(max(len(now) if e[1] is None else e[1], a), len(now))
                now = now[:a] + (e[2] or "") + now[b:]
        assert (r["n_tokens"], r["n_chars_edited"], r["n_tokens_edited"]) == (len(coder.encode_ordinary(t)), len(now), len(coder.encode_ordinary(now))), r["doc_id"]


def test_kept_trees_are_edited(spark, tmp_path):
    data, pattern = queries.byte_vocabulary()
    coder = bpe.ByteBPE(bpe.read_ranks(data), pattern)._core
    texts = [(1, " ".join(words(91, 4000))), (2, None), (3, ""), (4, "short"), (1, "another row of one id")]
    tokencount.count(with_clashes(spark.createDataFrame(texts, "doc_id long, text string")), data, pattern).write.parquet(str(tmp_path / "trees"))
    trees, want = spark.read.parquet(str(tmp_path / "trees")), [t or "" for _, t in texts]
    for turn in range(3):
        at = 100 * turn
        edit = f"array(named_struct('start', {at}, 'end', {at + 7}, 'text', 'new {turn} '), null)"
        trees = tokencount.edited(trees.withColumn("edits", F.expr(edit)), data, pattern)
        want = [t[: min(at, len(t))] + f"new {turn} " + t[min(at + 7, len(t)) :] for t in want]
    got = sorted((r["text"], r["n_tokens"], sum(x["tokens"] for x in r["leaves"]), r["n_reencoded"]) for r in trees.collect())
    assert [g[:3] for g in got] == sorted((t, n := len(coder.encode_ordinary(t)), n) for t in want)
    assert all(g[3] < 1500 for g in got) and max(len(t) for t in want) > 15_000


def test_toxicity_of_awkward_rows(spark):
    rude, plain = "you utter scum of a moron ", "a calm and plain remark on weather "
    rows = [(i, (rude if i % 3 == 0 else plain) + f"number {i}") for i in range(150)]
    labels = [(i, 0 if i % 3 == 0 else 1, int(i % 3 == 0)) for i in range(120)] + [(3, 0, 1), (1, None, None), (None, 1, 1), (900, 0, 1), (500, None, 1)]
    rows += [rows[0], rows[0], (None, rude), (500, None), (501, ""), (502, " \n"), (503, plain * 20_000 + rude)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("p_toxic", F.lit("x"))
    table = with_clashes(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    chain = toxicity.fit(docs, table, {"low": 1 - F.col("quality"), "toxic": F.col("toxic")})
    again = toxicity.fit(docs.repartition(3), table.repartition(2), {"low": 1 - F.col("quality"), "toxic": F.col("toxic")})
    assert [k.threshold for k in chain.links] == [k.threshold for k in again.links]
    got = toxicity.score(docs, chain, keep=["doc_id", "text", "p_toxic"]).collect()
    assert len(got) == len(rows) and list(got[0].asDict()) == ["doc_id", "text", "p_low", "is_low", "p_toxic", "is_toxic"]
    for r in got:
        if not (r["text"] or "").strip():
            assert r["p_toxic"] == 0 and not r["is_toxic"] and not r["is_low"]
        elif r["doc_id"] != 503:
            assert r["is_toxic"] == r["text"].startswith(rude) and 0 < r["p_toxic"] < 1
    assert len({r["p_toxic"] for r in got if r["doc_id"] == 0}) == 1
    none = toxicity.fit(docs, table.where("false"), {"toxic": F.col("toxic")})
    assert not any(r["is_toxic"] for r in toxicity.score(docs, none).collect())
    one_sided = toxicity.fit(docs, table.where("toxic = 1"), {"toxic": F.col("toxic")})
    assert toxicity.score(docs, one_sided).where("p_toxic > 0.9").count() == len(rows) - 3


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, and columns that bear the names of what the operators make."""
    import corpus_pipeline

    item, own = words(81, 20), words(82, 200)
    rows = [(1, " ".join(own), "en", "s", 0), (1, " ".join(own), "en", "s", 0), (2, " ".join(own[:-1] + ["z"]), None, None, None), (None, " ".join(own), "en", "s", 0), (3, None, None, None, None), (None, None, None, None, None)]
    rows += [(4, "", "en", "s", 0), (5, "\u0301 12", "en", "s", 5), (6, " ".join(item), "en", "s", 0), (7, "call a@b.example " + "x" * 100_000, "en", "s", 0), (8, " ".join(words(83, 300) + item[:13]), "en", "s", 0)]
    clash = ["lang_pred", "score", "spans", "hits", "items", "n_hit", "n_words", "kept", "component_id", "__added", "added", "base", "id", "class", "n_tokens", "ids"]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in clash})
    spark.createDataFrame([(1, " ".join(item)), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = {
        "language_id": [None, 1, 1, 2, 6, 7, 8], "near_dedup": [None, None, 1, 1, 3, 4, 5, 6, 7, 8], "decontamination": [None, None, 1, 1, 2, 3, 4, 5, 7, 8], "pii": [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8],
        "byte_bpe": [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8],
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        assert sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i)) == ids[name], name
        if name != "byte_bpe":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
            assert all(r[c] == (None if r["doc_id"] is None else f"{c} of {r['doc_id']}") for r in got for c in clash)
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
    masked = {r["doc_id"]: r["text"] for r in corpus_pipeline.pii(spark, docs, str(tmp_path)).collect()}
    assert masked[7].startswith("call [EMAIL] xxx") and masked[3] is None and masked[4] == ""
