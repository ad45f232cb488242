"""Writers. Each writes whole tables through Spark's committers; replacing is a commit of versions, adding goes by an index of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .keyindex import Appended, KeyedTable
from .versions import Versions


def append_new(batch: DataFrame, path: str, key: str) -> Appended:
    """Appends the rows whose key the JSON-lines table at path doesn't have yet; of equal keys one. Only files that may hold one of the keys are read."""
    return KeyedTable(batch.sparkSession, path, batch.schema, key, "json").append(batch)


def replace(df: DataFrame, path: str, format: str = "json") -> None:
    """Replaces the versioned table at path in one step (see versions.py). Readers, by current(), see the old table or the new one."""
    Versions(df.sparkSession, path).commit({"data": df}, format)


def current(spark: SparkSession, path: str, table: str = "data") -> DataFrame:
    """What replace(), write_split() or write_changed() last put at a path."""
    return Versions(spark, path).read(table)


def write_split(passed: DataFrame, rejected: DataFrame, path: str) -> int:
    """Replaces the tables `data` and, only if there are rejects, `rejected`, both in one step; returns the number of rejects."""
    n = rejected.count()
    Versions(passed.sparkSession, path).commit({"data": passed} | ({"rejected": rejected} if n else {}), "json")
    return n


def write_changed(new: DataFrame, path: str, flags: DataFrame, key: str, partition: str) -> dict[str, int]:
    """Rewrites a partitioned table only if some change flag isn't 'none'; returns the number of each flag.

    The rewrite replaces the whole table, so that a moved row is gone from its former partition.
    """
    counts = {r["change"]: r["n"] for r in flags.groupBy("change").agg(F.count("*").alias("n")).collect()}
    if any(k != "none" for k in counts):
        Versions(new.sparkSession, path).commit({"data": new}, partition=partition)
    return counts


def commit_checked(batches: dict[str, DataFrame], path: str, status: str = "status") -> int:
    """Replaces several tables in one step if no row of any is an error; else writes nothing and returns the number of errors."""
    errors = sum(df.where(F.col(status) == "error").count() for df in batches.values())
    if not errors:
        spark = next(iter(batches.values())).sparkSession
        Versions(spark, path).commit({name: df.drop(status) for name, df in batches.items()})
    return errors


def table_lines(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """(line): fixed-width lines of a report, numbers to the right."""
    numbers = {c for c, t in df.dtypes if t in ("int", "bigint", "double")}
    cells = [F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), w, " ") if c in numbers else F.rpad(F.coalesce(c, F.lit("-")), w, " ") for c, w in widths.items()]
    return df.select(F.concat_ws(" | ", *cells).alias("line"))


def purge(spark: SparkSession, path: str, id: str, prefix: str, confirm: bool = False) -> int:
    """Removes a source's rows from a versioned table and returns their number; without confirm it only counts."""
    rows = current(spark, path)
    gone = F.coalesce(F.col(id).startswith(f"{prefix}_"), F.lit(False))
    n = rows.where(gone).count()
    if confirm and n:
        replace(rows.where(~gone), path, "parquet")
    return n
