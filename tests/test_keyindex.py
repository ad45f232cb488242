"""Appends by an index of keys: equal to an anti-join, and few files are opened."""

import random

import pytest

from cardamom.sources.keyindex import Appended, KeyedTable

SCHEMA = "id long, v string"


def table(spark, tmp_path, **more):
    return KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "id", **more)


def batch(spark, ids, v="x", parts=1):
    return spark.createDataFrame([(i, v) for i in ids], SCHEMA).coalesce(parts)


def test_equals_an_anti_join(spark, tmp_path):
    rnd = random.Random(4)
    t, known = table(spark, tmp_path), {}
    for n in range(5):
        ids = [rnd.randint(0, 300) for _ in range(120)]
        done = t.append(batch(spark, ids, f"b{n}", 3))
        new = set(ids) - set(known)
        assert done.rows == len(new)
        known |= dict.fromkeys(new, f"b{n}")
        assert {r["id"]: r["v"] for r in t.read().collect()} == known and t.read().count() == len(known)


def test_only_files_that_may_hold_a_key_are_opened(spark, tmp_path):
    t = table(spark, tmp_path, rows_per_file=100)
    assert t.append(batch(spark, range(1000))) == Appended(1000, 0, 0)
    # beyond all ranges no file is opened, within one range one file
    assert t.append(batch(spark, range(5000, 5010))) == Appended(10, 0, 10)
    done = t.append(batch(spark, [250, 251, 9000]))
    assert done.rows == 1 and done.files == 11 and done.opened <= 2
    # keys of all ranges that no file has: filters tell nearly all
    t2 = KeyedTable(spark, str(tmp_path / "u"), SCHEMA, "id", rows_per_file=100)
    t2.append(batch(spark, range(0, 20000, 20)))
    done = t2.append(batch(spark, [7, 10007]))
    assert done.rows == 2 and done.files == 10 and done.opened <= 2


def test_rounds_of_filters(spark, tmp_path, monkeypatch):
    from cardamom.sources import keyindex

    monkeypatch.setattr(keyindex, "ROUND_BYTES", 200)
    t = table(spark, tmp_path, rows_per_file=50)
    t.append(batch(spark, range(400)))
    done = t.append(batch(spark, [*range(390, 410), 5]))
    assert done.rows == 10 and 2 <= done.opened <= 4


def test_files_that_the_index_lacks(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(batch(spark, [1, 2]))
    batch(spark, [3, 4]).write.mode("append").parquet(t.path)  # an append that stopped before its index
    assert t.append(batch(spark, [2, 3, 5])).rows == 1
    assert sorted(r["id"] for r in t.read().collect()) == [1, 2, 3, 4, 5]
    assert t.refresh() == 0


def test_null_and_repeated_keys_and_empty_batches(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.append(batch(spark, [])) == Appended(0, 0, 0) and t.read().count() == 0
    assert t.append(batch(spark, [None, None, 1, 1])).rows == 2
    assert t.append(batch(spark, [None, 1])).rows == 1
    assert t.append(batch(spark, [])).rows == 0
    u = KeyedTable(spark, str(tmp_path / "n"), SCHEMA, "id")
    assert [u.append(batch(spark, [None])).rows for _ in range(2)] == [1, 1]


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_string_keys(spark, tmp_path, format):
    t = KeyedTable(spark, str(tmp_path / "s"), "k string, n int", "k", format)
    rows = [("", 1), ("é", 2), ("a b/c%20", 3)]
    assert t.append(spark.createDataFrame(rows, "k string, n int")).rows == 3
    assert t.append(spark.createDataFrame([("é", 9), ("z", 4)], "k string, n int")).rows == 1
    assert sorted((r["k"], r["n"]) for r in t.read().collect()) == sorted([*rows, ("z", 4)])
