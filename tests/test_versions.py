"""Versioned tables: a reader sees whole tables after every step of a commit."""

import pytest
from pyspark.sql import functions as F

from cardamom.sources.versions import CommitConflict, Versions


class Stopped(Exception):
    pass


def values(versions, table="data", number=None):
    return sorted(r["v"] for r in versions.read(table, number).collect())


def numbers(spark, *v):
    return spark.createDataFrame([(x,) for x in v], "v long")


def test_stops_after_each_step_leave_whole_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    Versions(spark, path).commit({"data": numbers(spark, 1, 2), "rejected": numbers(spark, 9)})
    steps = []

    def note(name):
        steps.append(name)

    Versions(spark, str(tmp_path / "u"), note).commit({"data": numbers(spark, 3), "rejected": numbers(spark)})
    assert steps == ["write data", "write rejected", "write pointer", "rename pointer", "done"]
    for stop in steps:

        def stopping(name, stop=stop):
            if name == stop:
                raise Stopped(name)

        with pytest.raises(Stopped):
            Versions(spark, path, stopping).commit({"data": numbers(spark, 3), "rejected": numbers(spark)})
        reader = Versions(spark, path)
        new = stop == "done"
        assert values(reader) == ([3] if new else [1, 2]) and values(reader, "rejected") == ([] if new else [9])
    # four stopped commits and the first version's folder
    assert len(Versions(spark, path).recover()) == 4 and values(Versions(spark, path)) == [3]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 1
    assert Versions(spark, path).commit({"data": numbers(spark, 4)}) == 3


def test_a_stopped_commit_is_done_again(spark, tmp_path):
    path = str(tmp_path / "t")

    def stopping(name):
        if name == "rename pointer":
            raise Stopped(name)

    with pytest.raises(Stopped):
        Versions(spark, path, stopping).commit({"data": numbers(spark, 1)})
    assert Versions(spark, path).tables() == {}
    with pytest.raises(KeyError):
        Versions(spark, path).read()
    assert Versions(spark, path).commit({"data": numbers(spark, 1)}) == 1
    assert len(Versions(spark, path).recover()) == 1 and values(Versions(spark, path)) == [1]


def test_tables_that_read_themselves_and_others_that_stay(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "t"))
    t.commit({"data": numbers(spark, 1, 2), "other": numbers(spark, 7)})
    t.commit({"data": t.read().withColumn("v", F.col("v") + 1)})
    t.commit({"data": t.read().withColumn("w", F.col("v") % 2)}, "json", "w")
    assert values(t) == [2, 3] and t.read().columns == ["v", "w"] and values(t, "other") == [7]
    assert values(t, number=1) == [1, 2]
    t.commit({"other": None})
    assert set(t.tables()) == {"data"} and set(t.tables(3)) == {"data", "other"}
    t.recover(keep=2)
    assert t.numbers() == [3, 4] and values(t, "other", 3) == [7]


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    Versions(spark, path).commit({"data": numbers(spark, 1)})
    other = Versions(spark, path)

    def overtaken(name):
        if name == "write pointer":
            other.commit({"data": numbers(spark, 2)})

    with pytest.raises(CommitConflict):
        Versions(spark, path, overtaken).commit({"data": numbers(spark, 3)})
    assert values(Versions(spark, path)) == [2]


def test_empty_tables_keep_their_schema(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "t"))
    t.commit({"data": spark.createDataFrame([], "a struct<b: array<int>>, c timestamp_ntz")}, "json")
    assert t.read().count() == 0 and dict(t.read().dtypes) == {"a": "struct<b:array<int>>", "c": "timestamp_ntz"}
