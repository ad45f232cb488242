"""Repeatable samples and assignments. A row's place follows from a hash of its key and a seed, not from the order it comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def shuffled(key: Column, seed: int) -> Column:
    """An ordering key that looks random and is the same in every run."""
    return F.xxhash64(key, F.lit(seed))


def sample(rows: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The first n rows in an order: each task keeps n at most."""
    return rows.orderBy(*order).limit(n)


def stratified(rows: DataFrame, stratum: str, shares: dict[str, float], n: int, order: list[Column | str]) -> DataFrame:
    """round(share * n) rows of each named stratum, and of the others together (as 'rest') what is left of n."""
    takes = {k: round(v * n) for k, v in shares.items()}
    bucket = F.when(F.col(stratum).isin(list(takes)), F.col(stratum)).otherwise(F.lit("rest"))
    quota = F.create_map(*[F.lit(x) for k, v in (takes | {"rest": max(0, n - sum(takes.values()))}).items() for x in (k, v)])
    # the literal bound lets every task pass on n rows of a bucket at most
    placed = rows.withColumn("bucket", bucket).withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).where(F.col("place") <= n)
    return placed.where(F.col("place") <= F.element_at(quota, F.col("bucket")))


def least_per_stratum(rows: DataFrame, stratum: str, least: int, n: int, order: list[Column | str]) -> DataFrame:
    """`least` rows of each stratum first, then others, up to n rows in all.

    A row beyond place least + n of its stratum has n rows before it that go first, so each task passes on no more.
    """
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    near = rows.withColumn("__place", place).where(F.col("__place") <= least + n)
    return near.withColumn("first", F.col("__place") <= least).drop("__place").orderBy(F.col("first").desc(), *order).limit(n)


def top_k(rows: DataFrame, by: str, order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each group; each task passes on k of a group at most."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= k)


def placed(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """rows with `place`, from 0 on, in ascending order of the columns named.

    Rows are dealt by ranges of the order, which are numbered each by itself and begin where those
    before them end, so no task has all rows. The dealt rows are a stored table: their ranges are
    drawn once, and what is counted is what is numbered.
    """
    key = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)])
    ranged = stored(rows.withColumn("__key", key).repartitionByRange("__key").withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    # as many rows as ranges
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__range").orderBy("__key")) - 1
    return ranged.withColumn("__own", own).join(F.broadcast(starts), "__range").select(*rows.columns, (F.col("__start") + F.col("__own")).alias("place"))


def round_robin(plan: DataFrame, topics: list[str], order: list[Column | str]) -> DataFrame:
    """plan with a topic for each row, in turn over the whole plan."""
    at = (F.col("place") % len(topics)).cast("int")
    return placed(plan, order).withColumn("topic", F.element_at(F.array(*map(F.lit, topics)), at + 1)).drop("place")


def numbered(rows: DataFrame, by: str, base: Column, order: list[Column | str]) -> DataFrame:
    """rows with a number for each, from base + 1 on within its group.

    All rows are placed over ranges of the group and the order, so that a group of any size is no
    single task; a group begins at its least place.
    """
    whole = placed(rows, [by, *order])
    starts = whole.groupBy(F.col(by).alias("__by")).agg(F.min("place").alias("__from"))
    joined = whole.join(starts, F.col(by).eqNullSafe(F.col("__by")))
    return joined.withColumn("number", F.col("place") - F.col("__from") + 1 + base).select(*rows.columns, "number")
