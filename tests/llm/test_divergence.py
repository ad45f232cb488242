"""The divergence audit against a plain version on small tables. The whole query is compared with its SQL in test_queries.py."""

import re
from collections import Counter

import numpy as np

from cardamom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least, top=10):
    lower = {c: c + 32 for c in range(65, 91)}
    docs = [(lang or "", source or "", [t.translate(lower) for t in TERM.findall(text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        frequency = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted(t for t, n in frequency.items() if n >= least)
        v = len(kept)
        counts = {s: Counter(t for d in docs if d[:2] == (lang, s) for t in d[2] if frequency[t] >= least) for s in {d[1] for d in docs if d[0] == lang}}
        whole = sum(counts.values(), Counter())

        def p(count, c, v=v):
            return 1 + 10**9 * (c + 2) // (count.total() + 2 * v)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s, mine in counts.items():
            pairs = sorted((-sum(f(p(mine, mine[t]), p(o, o[t])) for t in kept), x.encode()) for x, o in counts.items() if x != s)
            terms = sorted((-f(p(mine, mine[t]), p(whole, whole[t])), t.encode()) for t in kept if mine[t] and p(mine, mine[t]) > p(whole, whole[t]))
            out += [(lang, s, "pair", x.decode(), -n, i + 1) for i, (n, x) in enumerate(pairs)] + [(lang, s, "term", x.decode(), -n, i + 1) for i, (n, x) in enumerate(terms[:top])]
    return sorted(out)


def audited(spark, rows, least, schema="lang string, source string, text string"):
    return sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, schema), least).select("lang", "source", "part", "item", "value", "rank").collect())


def test_equals_plain_version(spark):
    rng = np.random.default_rng(2)
    words = ["Alpha", "beta", "GAMMA", "дом", "d'or", "x1y", "été", "omega", "rare", "日本"]
    rows = [(str(rng.choice(["en", "fr"])), str(rng.choice(["s1", "s2", "s3", "Ω"])), " ".join(rng.choice(words, int(rng.integers(0, 9)))) + ("" if i else " only")) for i in range(120)]
    rows += [(None, None, "alpha beta alpha"), (None, "s1", None), ("zz", "s1", "one"), ("zz", "s2", ""), ("zz", None, "123 !")] + rows[:3]
    for least in (1, 3, 30):
        assert audited(spark, rows, least) == plain(rows, least)


def test_ties_go_by_bytes(spark):
    rows = [("en", "a", "x"), ("en", "b", "y"), ("en", "é", "y"), ("en", "\U0001f600", "y"), ("en", "￮", "y")]
    got = audited(spark, rows, 1)
    assert got == plain(rows, 1)
    assert [r[3] for r in sorted(got, key=lambda r: r[5]) if r[1:3] == ("a", "pair")] == ["b", "é", "￮", "\U0001f600"]


def test_empty_tables_and_clashing_columns(spark):
    assert audited(spark, [], 1) == []
    rows = [("en", "a", "x x", 1, "p"), ("en", "b", "z", 2, "q")]
    assert audited(spark, rows, 1, "lang string, source string, text string, n int, part string") == plain([r[:3] for r in rows], 1)


def test_sketch_never_underestimates(spark):
    rows = [("en", "s", " ".join(f"w{chr(97 + i % 26)}{chr(97 + j % 26)}" for j in range(i % 7 + 1))) for i in range(300)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    frequency = Counter(t for *_, text in rows for t in set(divergence.terms(text.encode())))
    bits = divergence.possible(docs, 4, 2, 1 << 16)
    found = {t: all(bits[a >> 3] >> (7 - (a & 7)) & 1 for a in divergence.cells("en", [t], 2, 1 << 16)[:, 0].tolist()) for t in frequency}
    assert all(found[t] for t, n in frequency.items() if n >= 4)
    assert not all(found.values())


def test_a_crowded_sketch_changes_no_result(spark, monkeypatch):
    rows = [("en", f"s{i % 3}", " ".join(f"w{chr(97 + (i * j) % 26)}" for j in range(9))) for i in range(60)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    wide = sorted(map(tuple, divergence.kept_counts(docs, 5).collect()))
    monkeypatch.setattr(divergence, "HELD", 3)
    assert sorted(map(tuple, divergence.kept_counts(docs, 5, 1, 1 << 16).collect())) == wide and wide


def test_counts_beyond_a_long(spark):
    got = spark.createDataFrame([(10**10, 3 * 10**10, 2)], "n long, total long, size long").select(divergence._p("n", "total", "size").alias("p")).first()["p"]
    assert got == 1 + 10**9 * (10**10 + 2) // (3 * 10**10 + 4)
