"""Coverage of rules by cases: hits, quotas, gaps, and what fills the gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hits_by_rule(hits: DataFrame, rule: str = "rule_id", origin: str = "origin", origins: tuple[str, ...] = ("real", "synthetic")) -> DataFrame:
    """One row for each rule with the number of violation rows of each origin: a rule twice in a case counts twice."""
    return hits.groupBy(rule).agg(*[F.count_if(F.col(origin) == o).alias(o) for o in origins])


def quota(rule: str, severity: str, defaults: dict[str, int | None], overrides: dict[str, int | None]) -> Column:
    """A rule's own quota if it has one (0 and null count), else its severity's."""
    out = F.lit(None).cast("int")
    for s, n in defaults.items():
        out = F.when(F.col(severity) == s, F.lit(n).cast("int")).otherwise(out)
    for r, n in overrides.items():
        out = F.when(F.col(rule) == r, F.lit(n).cast("int")).otherwise(out)
    return out


def gap(quota: Column, total: Column) -> Column:
    """max(0, quota - total); null for a null quota (greatest() alone would give 0)."""
    return F.when(quota.isNotNull(), F.greatest(F.lit(0), quota - total))


def coverage(rules: DataFrame, hits: DataFrame, defaults: dict[str, int | None], overrides: dict[str, int | None], rule: str = "rule_id", severity: str = "severity") -> DataFrame:
    """rule, severity, real, synthetic, total, quota, delta: rules without hits stay, with zeros.

    Rules are a small table beside the hits, which are aggregated before they are joined.
    """
    counted = rules.join(hits_by_rule(hits, rule), rule, "left").na.fill(0, ["real", "synthetic"])
    counted = counted.withColumn("total", F.col("real") + F.col("synthetic")).withColumn("quota", quota(rule, severity, defaults, overrides))
    return counted.select(rule, severity, "real", "synthetic", "total", "quota", gap(F.col("quota"), F.col("total")).cast("long").alias("delta"))


def totals(audit: DataFrame) -> DataFrame:
    """One row: sums, null for quota and delta if any quota is null, and the number of rules without hits."""
    open_ = F.bool_or(F.col("quota").isNull())
    return audit.agg(
        F.sum("real").alias("real"),
        F.sum("synthetic").alias("synthetic"),
        F.sum("total").alias("total"),
        F.when(~open_, F.sum("quota")).alias("quota"),
        F.when(~open_, F.sum("delta")).alias("delta"),
        F.count_if(F.col("total") == 0).alias("uncovered"),
    )


def allocate(audit: DataFrame, most: int, rule: str = "rule_id") -> DataFrame:
    """What each rule takes of `most` new cases, largest gap first: rule, delta, take; rules that take nothing are left out.

    The audit has a row for each rule of a taxonomy, so that one task may see all of it.
    """
    before = Window.orderBy(F.col("delta").desc(), rule).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(most) - F.coalesce(F.sum("delta").over(before), F.lit(0))
    return audit.where("delta > 0").withColumn("take", F.greatest(F.lit(0), F.least("delta", left))).where("take > 0").select(rule, "delta", "take")


def percentile_bounds(values: DataFrame, by: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """by, n, p_low, p_high over positive values: the element at floor(n * p), from 0, the last one at most.

    This is not percentile_disc. The ranks come from counts by value, so that a group's values are
    never gathered: a window runs over distinct values alone.
    """
    counted = values.where(F.col(value) > 0).groupBy(*by, value).agg(F.count("*").alias("c"))
    to = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("to", F.sum("c").over(to)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))

    def at(p: float) -> Column:
        place = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p)))
        return F.min(F.when(F.col("to") > place, F.col(value)))

    return placed.groupBy(*by).agg(F.max("n").alias("n"), at(low).alias("p_low"), at(high).alias("p_high"))


def field_coverage(rows: DataFrame, by: str, probes: dict[str, Column]) -> DataFrame:
    """by, field, filled, pct (rounded, of all rows of the group): how many rows fill each field."""
    sums = rows.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(p, F.lit(False))).alias(k) for k, p in probes.items()])
    long = sums.unpivot([by, "n"], list(probes), "field", "filled")
    return long.select(by, "field", "filled", F.round(F.col("filled") / F.col("n") * 100).cast("int").alias("pct"))


def next_number(ids: DataFrame, id: str, pattern: str) -> Column | DataFrame:
    """One row: the largest number that the pattern's first group reads from an id, and one; 1 if there is none."""
    return ids.agg((F.coalesce(F.max(F.regexp_extract(id, pattern, 1).try_cast("long")), F.lit(0)) + 1).alias("next"))
