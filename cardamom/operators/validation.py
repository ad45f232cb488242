"""Checks of records: error lists, splits into passed and rejected, field leaves, quotes and bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def errors(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail, in their order; a null outcome fails."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())


def split(rows: DataFrame, checks: dict[str, Column], column: str = "_validation_errors") -> tuple[DataFrame, DataFrame]:
    """(passed without, rejected with the list of errors)."""
    marked = rows.withColumn(column, errors(checks))
    return marked.where(F.size(column) == 0).drop(column), marked.where(F.size(column) > 0)


def unknown_keys(json: Column, known: list[str]) -> Column:
    """Keys of a JSON object that a closed schema doesn't have; null if it is no object."""
    return F.array_except(F.json_object_keys(json), F.array(*map(F.lit, known)))


def consistent(clean: Column, violations: Column) -> Column:
    """Clean means no violations, not clean means some, not annotated (null) means none."""
    return F.when(clean.isNull() | clean, F.size(violations) == 0).otherwise(F.size(violations) > 0)


def _leaves(path: Column, value: Column, kind: T.DataType) -> Column | None:
    """An array of struct<path, text> of all strings in a value; null where the type has none."""
    if isinstance(kind, T.StringType):
        return F.array(F.struct(path.alias("path"), value.alias("text")))
    if isinstance(kind, T.StructType):
        parts = [_leaves(F.concat(path, F.lit(f".{f.name}")), value[f.name], f.dataType) for f in kind.fields]
        parts = [p for p in parts if p is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, T.ArrayType) and _leaves(path, value, kind.elementType) is not None:
        each = F.transform(value, lambda x, i: _leaves(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), x, kind.elementType))
        return F.coalesce(F.flatten(each), F.array().cast("array<struct<path: string, text: string>>"))
    return None


def flatten(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """keep, path, text: every non-null string in a nested column, from the column's static type. Paths begin after the column's name."""
    kind = rows.schema[column].dataType
    made = _leaves(F.lit(""), F.col(column), kind)
    if made is None:
        return rows.select(*keep, F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("text")).where("false")
    each = rows.select(*keep, F.explode(made).alias("__leaf")).where("__leaf.text is not null")
    return each.select(*keep, F.ltrim(F.col("__leaf.path"), F.lit(".")).alias("path"), F.col("__leaf.text").alias("text"))


def quoted(claims: DataFrame, leaves: DataFrame, key: str, path: str = "path", quote: str = "quote") -> DataFrame:
    """claims with `found`: whether the text at their path holds their quote. No such path, and empty quotes, are not found."""
    side = leaves.select(key, F.col("path").alias(path), F.col("text").alias("__text"))
    joined = claims.join(side, [key, path], "left")
    return joined.withColumn("found", F.coalesce(F.contains("__text", quote) & (F.col(quote) != ""), F.lit(False))).drop("__text")


def outside(rows: DataFrame, value: str, bounds: DataFrame, by: list[str]) -> DataFrame:
    """rows whose value isn't within their group's bounds (p_low, p_high), which belong to it."""
    return rows.join(bounds.select(*by, "p_low", "p_high"), by).where(~F.col(value).between(F.col("p_low"), F.col("p_high")))


def diversity(rows: DataFrame, by: list[str], key: str, least: float = 0.4, small: int = 5) -> DataFrame:
    """by, n, ratio of different keys, warning: below `least`, strictly. Fewer than `small` rows have ratio 1 and no warning."""
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(key).alias("different"))
    ratio = F.when(F.col("n") < small, F.lit(1.0)).otherwise(F.col("different") / F.col("n"))
    return counted.select(*by, "n", ratio.alias("ratio"), ((F.col("n") >= small) & (ratio < least)).alias("warning"))
