"""Connected components of a graph given as edges, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvlake.sources.files import kept


def _step(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a > b, each node brought nearer to the least one that it can reach. Neighbours of a
    node are never gathered: a minimum of each node meets its edges in a join, which splits crowded nodes."""
    ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = kept(ends.groupBy("a").agg(F.least("a", F.min("b")).alias("least")))
    up = ends.join(least, "a").filter("b > a AND b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    lowest = up.groupBy("a").agg(F.min("b").alias("b"))
    others = up.join(lowest.withColumnRenamed("b", "low"), "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return lowest.unionByName(others).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for the nodes of edges (a, b), which are numbers; loops are dropped."""
    now = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == seen or not state.n:
            break
        seen, now = state, kept(_step(now))
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
