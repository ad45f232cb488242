"""Maintained totals against full audits."""

import random

from pyspark.sql import functions as F

from cardamom.operators import incremental

ROW = "id int, g string, v int"
CHANGES = f"id int, change string, before struct<{ROW.replace(' ', ':')}>, after struct<{ROW.replace(' ', ':')}>".replace(",:", ", ")


def full(spark, rows):
    out = {}
    for _, g, v in rows:
        n, s = out.get(g, (0, 0))
        out[g] = (n + 1, s + (v or 0))
    return out


def totals(audit):
    return {r["g"]: (r["n"], r["v"]) for r in audit.totals().collect()}


def audit(spark, path):
    return incremental.Audit(spark, str(path), ["g"], {"v": lambda r: r["v"]})


def test_ten_batches_and_one_twice(spark, tmp_path):
    rnd = random.Random(2)
    table, kept = {}, audit(spark, tmp_path / "t")
    assert kept.totals() is None
    for batch in range(10):
        before = dict(table)
        for i in rnd.sample(range(40), 12):
            if i in table and rnd.random() < 0.3:
                del table[i]
            else:
                table[i] = (i, rnd.choice(["a", "b", "c", None]), rnd.choice([None, rnd.randint(-5, 5)]))
        old, new = (spark.createDataFrame(sorted(t.values()), ROW) for t in (before, table))
        changed = incremental.changes(old, new, "id", ["g", "v"], "g").select("id", "change", "before", "after")
        assert changed.count() == len({i for i in {*before, *table} if before.get(i) != table.get(i)})
        assert kept.apply(changed, batch)
        if batch == 6:
            assert not kept.apply(changed, batch) and not kept.apply(changed, 3)
        assert totals(kept) == full(spark, table.values())
        # another stream has ids of its own
    assert kept.apply(changed.limit(0), 0, "other") and totals(kept) == full(spark, table.values())


def test_a_stream_that_starts_again(spark, tmp_path):
    log = [(i, "I", None, (i, "ab"[i % 2], i)) for i in range(6)]
    spark.createDataFrame(log[:4], CHANGES).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHANGES).parquet(str(tmp_path / "in"))
    kept = audit(spark, tmp_path / "t")
    kept.follow(stream, str(tmp_path / "cp")).awaitTermination()
    assert totals(kept) == {"a": (2, 2), "b": (2, 4)}
    spark.createDataFrame(log[4:], CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    audit(spark, tmp_path / "t").follow(stream, str(tmp_path / "cp")).awaitTermination()
    assert totals(kept) == {"a": (3, 6), "b": (3, 9)}
    # the same files once more, as a checkpoint that was lost would bring them
    audit(spark, tmp_path / "t").follow(stream.where(F.col("id") < 4), str(tmp_path / "cp2")).awaitTermination()
    assert totals(kept) == {"a": (3, 6), "b": (3, 9)}
