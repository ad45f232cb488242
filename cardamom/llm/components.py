"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


#: Parts that the neighbours of one node are split into.
PARTS = 64


def _parted(edges: DataFrame) -> DataFrame:
    return edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int"))


def _lower_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m, parts): each node's smallest neighbour, and which parts its neighbours are in."""
    by_part = _parted(edges).groupBy("u", "part").agg(F.min("v").alias("m"))
    return by_part.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("part").alias("parts"))


def _with_lowest(edges: DataFrame, low: DataFrame) -> DataFrame:
    """edges with m, part by part: a node's neighbours meet its minimum in as many tasks as they have parts."""
    return _parted(edges).join(low.select("u", "m", F.explode("parts").alias("part")), ["u", "part"]).drop("part")


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has an edge.

    Alternates two steps until nothing changes: every node's larger neighbours are tied to its
    smallest one, then its smaller neighbours and itself. The depth of every tree falls by a factor in
    each round. A node's minimum is aggregated, by parts first, and joined back by parts, so no task gathers the
    neighbours of a node, however many it has. Rounds are cut by tables in the shared folder.
    """
    spark = edges.sparkSession
    now = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = None
    if not now.limit(1).count():
        return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lower_neighbour(both).select("u", F.least("m", "u").alias("m"), "parts")
        large = _with_lowest(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u != v").distinct(), "large")
        low = _lower_neighbour(large)
        small = _with_lowest(large, low).where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = stored(small.where("u != v").distinct(), "small")
        was, state = state, new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, now)
        discard(spark, large)
        now = new
        if was == state:
            roots = now.select(F.col("v").alias("id")).distinct()
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
