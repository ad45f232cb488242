"""Quality, agreement, cost and latency of competing models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdict(severities: Column) -> Column:
    """reject if any is critical or high, else needs_review if any is medium, else approve; no violations are approved."""
    return F.when(F.arrays_overlap(severities, F.array(F.lit("critical"), F.lit("high"))), F.lit("reject")).when(F.array_contains(severities, "medium"), F.lit("needs_review")).otherwise(F.lit("approve"))


def outcomes(expected: DataFrame, predicted: DataFrame, case: str, rule: str) -> DataFrame:
    """case, rule, tp, fp, fn of every (case, rule) on either side; repeated findings count once."""
    e = expected.select(case, rule).distinct().withColumn("__e", F.lit(True))
    p = predicted.select(case, rule).distinct().withColumn("__p", F.lit(True))
    both = e.join(p, [case, rule], "full_outer")
    has_e, has_p = F.col("__e").isNotNull(), F.col("__p").isNotNull()
    return both.select(case, rule, (has_e & has_p).cast("int").alias("tp"), (~has_e & has_p).cast("int").alias("fp"), (has_e & ~has_p).cast("int").alias("fn"))


def scores(outcomes: DataFrame, *by: str) -> DataFrame:
    """by, tp, fp, fn, precision, recall, f1. A ratio without cases is null; F1 is 0 where there are no true positives but errors."""
    s = outcomes.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return s.select(
        *by, "tp", "fp", "fn",
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"),
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def macro(by_rule: DataFrame, *by: str) -> DataFrame:
    """Means over the rules; a rule's null is left out of that mean."""
    return by_rule.groupBy(*by).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.count("*").alias("rules"))


def hallucination_rate(findings: DataFrame, source: str, quote: str, *by: str) -> DataFrame:
    """Share of findings whose quote isn't in the source; a null or empty quote isn't either."""
    false = ~F.coalesce(F.contains(source, quote) & (F.col(quote) != ""), F.lit(False))
    return findings.groupBy(*by).agg(F.count("*").alias("findings"), F.count_if(false).alias("false"), F.avg(false.cast("int")).alias("rate"))


def confusion(pairs: DataFrame, expected: str, predicted: str, values: list[str], *by: str) -> DataFrame:
    """by, expected, and a count of each predicted value."""
    return pairs.groupBy(*by, expected).pivot(predicted, values).count().na.fill(0, values)


def agreement(runs: DataFrame, case: str, run: str, rule: str, every: DataFrame, *by: str) -> DataFrame:
    """Share of cases with the same set of rules in all runs. `every` has a row for each (by, case, run), findings or not."""
    sets = runs.groupBy(*by, case, run).agg(F.array_sort(F.collect_set(rule)).alias("rules"))
    filled = every.join(sets, [*by, case, run], "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<string>")))
    same = filled.groupBy(*by, case).agg((F.count_distinct(F.array_join("rules", ",")) == 1).alias("same"))
    return same.groupBy(*by).agg(F.count("*").alias("cases"), F.avg(F.col("same").cast("int")).alias("agreement"))


def gates(models: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Models that meet every limit, in the order macro-F1 (best first), cost, p95 latency, with their rank."""
    from pyspark.sql import Window

    kept = models
    for column, least in limits.items():
        kept = kept.where(F.col(column) >= least)
    order = Window.orderBy(F.col("f1").desc(), "cost", "p95", "model")
    return kept.withColumn("place", F.row_number().over(order))
