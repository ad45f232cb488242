"""Connected components against union-find, and how the rows of a node with very many neighbours are spread over tasks."""

import random

from pyspark.sql import functions as F

from cardamom.llm import components


def plain(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def test_any_graph(spark):
    pick = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(9000, i) for i in range(1000, 1400)]
    some = [(pick.randrange(2000, 2200), pick.randrange(2000, 2200)) for _ in range(150)]
    for edges in ([], [(3, 3)], [(2, 1), (1, 2), (2, 1)], chain + star + some + [(130, 1200), (7, 7)]):
        got = components.connected(spark.createDataFrame(edges, "a long, b long"))
        assert sorted((r["id"], r["component"]) for r in got.collect()) == sorted(plain(edges).items())


def test_a_star_is_split_over_tasks(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        star = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
        pairs = spark.range(200_000, 205_000, 2).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
        edges = star.unionByName(pairs)
        joined = components._with_lowest(edges, components._lower_neighbour(edges))
        tasks = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert sum(tasks) == 102_500 and max(tasks) < sum(tasks) / 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
