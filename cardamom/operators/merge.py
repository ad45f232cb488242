"""Merges and incremental stores. Each gives the new state, or a plan of changes, as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_rows(batch: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Rows of keys that the store doesn't have, to be appended; of equal keys one."""
    return batch.join(store.select(key), key, "left_anti").dropDuplicates([key])


def upsert(store: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by `order`; rows of the batch come after the store's."""
    both = store.withColumn("__pass", F.lit(0)).unionByName(batch.withColumn("__pass", F.lit(1)))
    rest = [c for c in store.columns if c != key]
    last = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("__pass", order)).alias("__last"))
    return last.select(*[F.col(key) if c == key else F.col(f"__last.{c}").alias(c) for c in store.columns])


def merge_columns(store: DataFrame, batch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The store with some columns taken from the batch where it has the key; all others stay. Keys of the batch alone are left out."""
    side = batch.select(key, F.lit(True).alias("__has"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = store.join(side, key, "left")
    return joined.select(*[F.when(F.col("__has"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in store.columns])


def append_status(batch: DataFrame, store: DataFrame, key: str, order: str) -> DataFrame:
    """batch with status: 'error' for keys of the store and for all but the first of a key in the batch, else 'ok'."""
    known = store.select(key, F.lit(True).alias("__known"))
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    marked = batch.join(known, key, "left").withColumn("__n", first)
    status = F.when(F.col("__known") | (F.col("__n") > 1), F.lit("error")).otherwise(F.lit("ok"))
    return marked.select(*batch.columns, status.alias("status"))


def committed(batch: DataFrame, status: str = "status") -> DataFrame:
    """The batch if no row of it is an error, else no rows: all or nothing."""
    errors = batch.agg(F.count_if(F.col(status) == "error").alias("__errors"))
    return batch.crossJoin(F.broadcast(errors)).where("__errors = 0").drop("__errors")


def change_flags(old: DataFrame, new: DataFrame, key: str, content: list[str], partition: str) -> DataFrame:
    """key, change for keys of either side: I, U, D, M (moved to another partition), or none where nothing changed."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    a = old.select(key, digest.alias("ha"), F.col(partition).alias("pa"))
    b = new.select(key, digest.alias("hb"), F.col(partition).alias("pb"))
    change = F.when(F.col("ha").isNull(), F.lit("I")).when(F.col("hb").isNull(), F.lit("D")).when(F.col("pa") != F.col("pb"), F.lit("M")).when(F.col("ha") != F.col("hb"), F.lit("U")).otherwise(F.lit("none"))
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def keep_best(rows: DataFrame, key: str, size: str, order: str, least: int = 0) -> DataFrame:
    """Of each key the row of the largest size, the first in `order` of equals; sizes below `least` don't count."""
    best = rows.where(F.col(size) >= least).groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(F.col(size), -F.col(order))).alias("__best"))
    return best.select(*[F.col(key) if c == key else F.col(f"__best.{c}").alias(c) for c in rows.columns])


def two_passes(a: DataFrame, b: DataFrame, keys: list[str], names: tuple[str, str] = ("cons", "aggr")) -> DataFrame:
    """Findings of two annotators, each once, marked with who had them."""
    left = a.select(*keys).distinct().withColumn("__a", F.lit(True))
    right = b.select(*keys).distinct().withColumn("__b", F.lit(True))
    by = F.when(F.col("__b").isNull(), F.lit(names[0])).when(F.col("__a").isNull(), F.lit(names[1])).otherwise(F.lit("both"))
    return left.join(right, keys, "full_outer").select(*keys, by.alias("found_by"))


def delete_plan(rows: DataFrame, id: str, prefix: str) -> DataFrame:
    """The rows that a delete by source would remove."""
    return rows.where(F.col(id).startswith(f"{prefix}_"))


def strip(rows: DataFrame, where: Column, columns: list[str]) -> DataFrame:
    """rows with some columns set to null where the condition holds, and `touched` where one of them had a value."""
    had = F.lit(False)
    for c in columns:
        had = had | F.col(c).isNotNull()
    cleared = [F.when(~F.coalesce(where, F.lit(False)), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns]
    return rows.select(*cleared, F.coalesce(where & had, F.lit(False)).alias("touched"))
