"""Connected components by alternating large-star and small-star steps, each one aggregate and one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import drop, store


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    across = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return across.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b: long) that isn't its component's smallest; root is that smallest node."""
    now = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        row = now.agg(F.count("*").alias("n"), F.count_distinct("a").alias("d")).first()
        # stars: every node but a root has one edge, and no root has one of its own
        if row.n == row.d and now.join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        new = store(_small_star(_large_star(now)), "edges")
        drop(now)
        now = new
