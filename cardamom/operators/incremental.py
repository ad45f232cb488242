"""Audits that are kept up to date: counts and sums by group, maintained from signed changes.

A change has the row before and after it (null for an insert or a delete). It takes its row's values from the
groups that it was in and adds them to those that it is in now, so a batch costs what its changes cost, not
what the table does. The totals and the highest batch id that is in them are replaced in one commit:
a batch that comes twice, as one does when a stream is started again, counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Versions
from .merge import change_flags


def changes(old: DataFrame, new: DataFrame, key: str, content: list[str], partition: str) -> DataFrame:
    """key, change (I, U, D or M), before, after: of the rows that change_flags() finds changed. Both sides have the same columns."""
    flags = change_flags(old, new, key, content, partition).where("change != 'none'")
    a, b = (df.select(F.col(key).alias("__k"), F.struct(*old.columns).alias(name)) for df, name in ((old, "before"), (new, "after")))
    joined = flags.join(a, flags[key] == a["__k"], "left").drop("__k")
    return joined.join(b, joined[key] == b["__k"], "left").select(key, "change", "before", "after")


class Audit:
    """Totals by group at a path. `by` are the columns of a row that make a group, `sums` whole numbers that are added up; `n` counts rows.

    Null in a sum is 0; nulls make a group of their own. Groups without rows go.
    """

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str], sums: dict[str, Callable[[Column], Column]]) -> None:
        self.by, self.sums, self._names = list(by), sums, ["n", *sums]
        self._versions = Versions(spark, path)
        self._spark = spark

    def totals(self) -> DataFrame | None:
        """The groups with n and the sums; None before the first batch."""
        return self._versions.read("totals") if "totals" in self._versions.tables() else None

    def _applied(self) -> dict[str, int]:
        if "batches" not in self._versions.tables():
            return {}
        # a row for each stream
        return {r["stream"]: r["batch"] for r in self._versions.read("batches").collect()}

    def _deltas(self, changed: DataFrame) -> DataFrame:
        signed = changed.select(F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("sign"), F.col("before").alias("row")), F.struct(F.lit(1).cast("long").alias("sign"), F.col("after").alias("row")))).alias("x")).where("x.row is not null")
        row, sign = F.col("x.row"), F.col("x.sign")
        values = [sign.alias("n"), *[(sign * F.coalesce(f(row), F.lit(0)).cast("long")).alias(name) for name, f in self.sums.items()]]
        return signed.select(*[row[c].alias(c) for c in self.by], *values)

    def apply(self, changed: DataFrame, batch: int, stream: str = "") -> bool:
        """Adds a batch of changes to the totals; False if it is in them already. Batches of one stream come in the order of their ids."""
        applied = self._applied()
        if applied.get(stream, -1) >= batch:
            return False
        rows = self._deltas(changed)
        before = self.totals()
        if before is not None:
            rows = rows.unionByName(before)
        sums = rows.groupBy(*self.by).agg(*[F.sum(c).alias(c) for c in self._names])
        empty = F.lit(True)
        for c in self._names:
            empty = empty & (F.col(c) == 0)
        batches = self._spark.createDataFrame(list((applied | {stream: batch}).items()), "stream string, batch long")
        self._versions.commit({"totals": sums.where(~empty), "batches": batches})
        self._versions.recover(keep=2)
        return True

    def follow(self, changed: DataFrame, checkpoint: str, stream: str = "stream"):
        """Applies the batches of a streaming table of changes; returns the running query. What is there at its start is taken, then it ends."""
        return changed.writeStream.foreachBatch(lambda df, id: self.apply(df, id, stream) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
