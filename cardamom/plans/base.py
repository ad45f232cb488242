"""How the engine's subjects are bound to the driver's tables.

Cards are documents, a card's site is its source, annotations are labels (quality 1: clean, toxic 1:
a violation of the rule that bears the source's name), and the taxonomy is the set of sources with
severities in turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import load

SEVERITIES = ("critical", "high", "medium", "low")
DEFAULTS: dict[str, int | None] = {"critical": 10, "high": 7, "medium": 5, "low": None}
OVERRIDES: dict[str, int | None] = {"src3": 2, "src4": 0}

RULES_SQL = "rules AS (SELECT DISTINCT source AS rule_id, list_extract(['critical', 'high', 'medium', 'low'], CAST(substr(source, 4) AS INT) % 4 + 1) AS severity FROM documents)"
HITS_SQL = "hits AS (SELECT doc_id, source AS rule_id, CASE WHEN doc_id % 2 = 0 THEN 'real' ELSE 'synthetic' END AS origin FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"
QUOTA_SQL = "CASE rule_id WHEN 'src3' THEN 2 WHEN 'src4' THEN 0 ELSE CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 7 WHEN 'medium' THEN 5 END END"


def rules(spark: SparkSession, d: str) -> DataFrame:
    n = F.substring("rule_id", 4, 9).cast("int") % 4
    return load(spark, d, "documents").select(F.col("source").alias("rule_id")).distinct().select("rule_id", F.element_at(F.array(*map(F.lit, SEVERITIES)), n + 1).alias("severity"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = load(spark, d, "documents", "labels")
    origin = F.when(F.col("doc_id") % 2 == 0, F.lit("real")).otherwise(F.lit("synthetic"))
    return docs.select("doc_id", F.col("source").alias("rule_id")).join(labels.where("toxic = 1"), "doc_id").select("doc_id", "rule_id", origin.alias("origin"))
