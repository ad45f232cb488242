"""Where queries and the SQL they must equal are entered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Enters a function under its name, with the DuckDB SQL of the same rows if there is one."""

    def enter(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return enter


def load(spark: SparkSession, sf_dir: str, *names: str):
    frames = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
    return frames[0] if len(frames) == 1 else frames
