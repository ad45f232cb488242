"""Queries over whole tables, against plain versions of themselves: no row, word or text is left out for its id or its length."""

import re

import __spark_entry__ as contract
from cardamom.operators import joins


def table(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


def rows(spark, path, name):
    return sorted(tuple(r) for r in contract.queries()[name](spark, str(path)).collect())


def words(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_long_documents_meet_the_benchmark(spark, tmp_path, monkeypatch):
    item = words("item", 250)
    texts = [item + " " + words("tail", 100), words("item", 20), words("other", 400)]
    table(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    table(spark, tmp_path, "benchmark", [(7, item)], "item_id long, text string")

    def sets(text):
        t = text.split()
        return {tuple(t[i : i + 5]) for i in range(len(t) - 4)}

    pairs = [(i, 7, len(sets(t) & sets(item)) / len(sets(t) | sets(item))) for i, t in enumerate(texts)]
    want = [(a, b, round(s, 9)) for a, b, s in pairs if s > 0.1]
    assert len(texts[0]) > 1000 and [a for a, _, _ in want] == [0]
    assert rows(spark, tmp_path, "v10_benchmark_overlap") == want
    monkeypatch.setattr(joins, "BROADCAST_GRAMS", 10)
    assert rows(spark, tmp_path, "v10_benchmark_overlap") == want


def test_levels_of_all_documents(spark, tmp_path):
    ids = [0, 11, 13, 999, 1000, 5001, 12345]
    table(spark, tmp_path, "documents", [(i, f"src{i % 2}") for i in ids] + [(20_000 + 2 * i, "src4") for i in range(1001)], "doc_id long, source string")
    table(spark, tmp_path, "labels", [(i, 1, int(i == 5001)) for i in ids[1:]] + [(20_000 + 2 * i, 0, 0) for i in range(1001)], "doc_id long, quality int, toxic int")
    got = dict(rows(spark, tmp_path, "v6_pending_levels"))
    assert len(got) == len(ids) + 1001
    few = {k: v for k, v in got.items() if "_src4_" not in k}
    assert few == {"real_src0_001": "error", "synth_src1_001": "warn", "real_src1_002": "error", "synth_src1_003": "ok", "synth_src0_002": "ok", "synth_src1_004": "error", "synth_src1_005": "ok"}
    assert got["synth_src4_998"] == "ok"
    assert {v for k, v in got.items() if k.endswith(("_1000", "_1001"))} == {"error"}


def test_cards_of_all_orders(spark, tmp_path):
    keys = range(1, 24)
    table(spark, tmp_path, "orders", [(k, "1-URGENT", "F") for k in keys], "o_orderkey long, o_orderpriority string, o_orderstatus string")
    table(spark, tmp_path, "part", [(1, "green tile")], "p_partkey long, p_name string")
    table(spark, tmp_path, "lineitem", [(k, n, 1, "R") for k in keys if k % 2 for n in (1, 2)], "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string")
    want = []
    for k in keys:
        want += [(k, "title", "1-URGENT"), (k, "location.address", "F")]
        want += [(k, f"program_items[{i}].{f}", t) for i in range(2 if k % 2 else 0) for f, t in (("title", "green tile"), ("description", "R"))]
    assert rows(spark, tmp_path, "p26_leaf_flatten") == sorted(want)
    held = {(k, p): t for k, p, t in want}
    claims = [(k, ["title", "program_items[1].title", "program_items[9].title", "location"][k // 10 % 4], "i" if k % 30 == 0 else "e") for k in keys]
    assert rows(spark, tmp_path, "p25_quote_check") == sorted((k, p, q, q in held.get((k, p), "")) for k, p, q in claims)
    assert any(found for *_, found in rows(spark, tmp_path, "p25_quote_check"))


def test_plans_take_all_rows(spark, tmp_path):
    docs = [(i, f"src{i % 2}", "en" if i % 6 < 3 else "fr") for i in range(2500)] + [(2501, "src9", "de"), (2503, "src8", "de"), (2505, "src7", "de"), (2502, "src7", "de")]
    table(spark, tmp_path, "documents", docs, "doc_id long, source string, lang string")
    table(spark, tmp_path, "labels", [(i, 1, 0) for i in (1, 2, 3)], "doc_id long, quality int, toxic int")
    table(spark, tmp_path, "pages", [(i, f"https://h/{i}") for i in range(12)], "page_id long, url string")
    mixed = sorted(((i * 7919 + 42) % 10007, i) for i, *_ in docs)
    assert rows(spark, tmp_path, "w2_round_robin") == sorted((i, at % 12) for at, (_, i) in enumerate(mixed))
    seen, ids = {}, []
    for i, source, _ in sorted(docs):
        seen[source] = seen.get(source, 3) + 1
        ids.append((i, f"synth_{source}_{seen[source]:03}"))
    assert rows(spark, tmp_path, "w3_ids") == ids and len({x for _, x in ids}) == len(docs)
    first = {}
    for i, *_ in sorted(docs):
        first.setdefault(i % 400, i)
    assert rows(spark, tmp_path, "m3_append_status") == sorted((i % 400, i, "error" if first[i % 400] != i or i % 400 in (1, 2) else "ok") for i, *_ in docs)
    passes = {name: {d[1:] for d in docs if d[0] % 3 != gone} for name, gone in (("cons", 1), ("aggr", 2))}
    both = passes["cons"] & passes["aggr"]
    want = [(*k, "both" if k in both else "cons" if k in passes["cons"] else "aggr") for k in {d[1:] for d in docs}]
    assert {x for *_, x in want} == {"cons", "aggr", "both"} and rows(spark, tmp_path, "m11_two_passes") == sorted(want)
    assert {r[0] for r in rows(spark, tmp_path, "k6_url_list")} >= {f"https://h/{i}" for i in range(12)}


def test_places_are_dealt_over_ranges(spark):
    from pyspark.sql import functions as F

    from cardamom.operators import sampling

    got = sampling.placed(spark.range(5000).select("id", (F.col("id") % 7).alias("k")), ["k", "id"])
    assert [r["place"] for r in got.orderBy("k", "id").collect()] == list(range(5000))
    assert "__range" in got._jdf.queryExecution().optimizedPlan().toString()
    for n in (0, 1):
        assert [r["place"] for r in sampling.placed(spark.range(n), ["id"]).collect()] == list(range(n))


def test_long_texts_have_set_sizes(spark, tmp_path):
    texts = [words("a", 600), words("a", 500), words("b", 10), words("B", 700)]
    table(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    sets = [set(t.lower().split(" ")) for t in texts]
    want = [(i, i + 1, len(a), len(b), len(a & b), round(len(a & b) / len(a | b), 6)) for i, (a, b) in enumerate(zip(sets, sets[1:]))]
    assert len(want) == 3 and rows(spark, tmp_path, "a13_jaccard_sizes") == want


def test_days_of_long_turns(spark, tmp_path):
    turns = [(1, 0, "user", words("u", 300)), (1, 1, "assistant", "x" * 1500), (1, 2, "user", "y"), (1, 3, "assistant", "z" * 10), (2, 0, "assistant", "early"), (2, 1, "user", "u" * 2000)]
    table(spark, tmp_path, "conversations", turns, "conv_id long, turn int, role string, text string")
    assert rows(spark, tmp_path, "p19_day_groups") == [(1, 2, 1510), (2, 1, None)]


def test_words_to_the_end(spark, tmp_path):
    texts = [words("w", 45) + " " + words("w", 50), "a  b a", "one"]
    table(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    table(spark, tmp_path, "conversations", [(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string")
    assert rows(spark, tmp_path, "m7_ordered_distinct") == [(i, " ".join(dict.fromkeys(t.split(" ")))) for i, t in enumerate(texts)]
    assert rows(spark, tmp_path, "w5_positions") == [(i, at, w) for i, t in enumerate(texts) for at, w in enumerate(t.split(" "))]
    assert rows(spark, tmp_path, "l4_ocr_text") == [(1, "\n".join(texts))]
