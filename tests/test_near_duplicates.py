"""Near-duplicates against all pairs, and how much of the shingles is written on the way."""

import random

import pytest
from pyspark.sql import functions as F

from cardamom.operators import joins


def _texts():
    rnd = random.Random(7)
    passage = [f"p{i}" for i in range(25)]
    texts = []
    for _ in range(40):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(30, 90))] + passage
        texts.append(base)
        for _ in range(rnd.randrange(3)):
            near = list(base)
            for _ in range(rnd.randrange(4)):
                near[rnd.randrange(len(near))] = f"x{rnd.randrange(9)}"
            texts.append(near[: rnd.choice([len(near), len(near) - 5])])
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, "too short"), (901, None)]


def _shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.mark.parametrize("sampled", [1, 8])
def test_pairs_and_links_with_each_shingle_written_once(spark, monkeypatch, sampled):
    rows = _texts()
    sets = {i: s for i, t in rows if (s := _shingles(t))}
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) / len(x | y) > 0.7}
    assert len(want) > 30
    written, stored = [], joins.stored

    def kept(df, name):
        written.append(stored(df, name))
        return written[-1]

    monkeypatch.setattr(joins, "stored", kept)
    monkeypatch.setattr(joins, "SAMPLED", sampled, raising=False)
    docs = spark.createDataFrame(rows, "id int, t string")
    got = {(r["a"], r["b"]): r["similarity"] for r in joins.near_duplicates(docs, "id", "t").collect()}
    assert got == want
    every = sum(map(len, sets.values()))
    assert sum(t.select(F.sum(F.size("s"))).first()[0] for t in written if "s" in t.columns) <= every
    written.clear()
    links = {r["id"]: r["links"] for r in joins.near_duplicate_links(docs, "id", "t").collect()}
    assert links == {i: sum(i in p for p in want) for i, _ in rows}
    assert sum(t.where("s is not null").select(F.sum(F.size("s"))).first()[0] for t in written if "s" in t.columns) <= every
