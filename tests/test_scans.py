"""Running values, as-of joins and segments, in groups that span several ranges."""

import random

import pytest
from pyspark.sql import functions as F

from cardamom.operators import provider, scans

KINDS = {"sum": lambda s, v: v if s is None else s + v, "max": lambda s, v: v if s is None else max(s, v), "min": lambda s, v: v if s is None else min(s, v), "last": lambda s, v: v}


def running(rows, kind):
    state, out = {}, {}
    for g, at, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if v is not None:
            state[g] = KINDS[kind](state.get(g), v)
        out[g, at] = state.get(g)
    return out


@pytest.mark.parametrize("groups", [[0], [0, 0, 0, 1, None], list(range(40))])
def test_running_values_over_ranges(spark, groups):
    rnd = random.Random(len(groups))
    rows = [(rnd.choice(groups), i, rnd.choice([None, rnd.randint(-9, 9)])) for i in rnd.sample(range(5000), 600)]
    df = spark.createDataFrame(rows, "g int, at int, v long")
    got = scans.scan(df, "g", ["at"], {k: scans.Running(k, F.col("v")) for k in KINDS}, ranges=7).collect()
    assert len(got) == len(rows)
    for k in KINDS:
        assert {(r["g"], r["at"]): r[k] for r in got} == running(rows, k)


def test_one_group_runs_over_several_tasks(spark):
    df = spark.range(2000).select(F.lit(1).alias("g"), F.col("id").alias("at"), (F.col("id") % 100 == 0).alias("s"))
    sizes = [r["n"] for r in scans.ranged(df, "g", [F.col("at")], 8).groupBy("__range").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 6 and max(sizes) < 600
    got = scans.segments(df, "g", ["at"], F.col("s"), 8).collect()
    assert all(r["segment"] == r["at"] // 100 + 1 for r in got) and len(got) == 2000


@pytest.mark.parametrize("owners", [[1], [1, 2, None], list(range(30))])
def test_as_of(spark, owners):
    rnd = random.Random(7)
    left = [(i, rnd.choice(owners), rnd.choice([None, rnd.randint(0, 500)])) for i in range(400)]
    right = [(rnd.choice(owners), rnd.choice([None, rnd.randint(0, 500)]), i) for i in range(60)]
    a, b = spark.createDataFrame(left, "id int, o int, t int"), spark.createDataFrame(right, "o int, since int, x int")
    got = {r["id"]: (r["since"], r["x"]) for r in scans.asof(a, b, "o", "t", "since", ["since", "x"], 6).collect()}
    for i, o, t in left:
        met = [(s, x) for p, s, x in right if None not in (o, t, p, s) and p == o and s <= t]
        assert got[i] == max(met, default=(None, None))
    assert len(got) == len(left)
    assert scans.asof(a, b.limit(0), "o", "t", "since", ["x"], 2).where("x is not null").count() == 0
    assert scans.asof(a.limit(0), b, "o", "t", "since", ["x"], 2).count() == 0


def test_tokens_end_before_their_time(spark):
    calls = spark.createDataFrame([(i, "a", f"2024-01-01 00:{m:02d}:{s:02d}") for i, (m, s) in enumerate([(0, 0), (1, 0), (28, 59), (29, 0), (31, 0), (40, 0)])] + [(9, "b", "2024-01-01 00:02:00")], "id int, o string, t string").withColumn("t", F.to_timestamp("t"))
    tokens = spark.createDataFrame([("a", "2024-01-01 00:01:00"), ("a", "2024-01-01 00:31:00")], "o string, issued string").withColumn("issued", F.to_timestamp("issued"))
    got = {r["id"]: r["issued"] and r["issued"].minute for r in provider.with_tokens(calls, tokens, "o", "t", 1800).collect()}
    assert got == {0: None, 1: 1, 2: 1, 3: None, 4: 31, 5: 31, 9: None}
    plan = provider.with_tokens(calls, tokens, "o", "t", 1800)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan


def test_titles_and_bodies(spark):
    rows = [(1, 0, "before", False), (1, 1, "T" * 200, True), (1, 2, "ab", False), (1, 3, "abc", False), (1, 4, None, False), (1, 5, "Second", True), (1, 6, "", True)]
    rows += [(2, i, "x" * 10, False) for i in range(5)] + [(3, 0, "Long", True)] + [(3, i, "y" * 10, False) for i in range(1, 900)]
    df = spark.createDataFrame(rows, "g int, at int, text string, title boolean")
    got = {(r["g"], r["segment"]): (r["title"], r["body"]) for r in scans.segment_texts(df, "g", "at", F.col("text"), F.col("title"), ranges=5).collect()}
    assert got == {(1, 1): ("T" * 120, "before | abc"), (1, 2): ("Second", ""), (1, 3): ("", ""), (3, 1): ("Long", " | ".join(["y" * 10] * 899)[:4000])}
