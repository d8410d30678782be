"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvlake.llm.shared import cut


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (a, b) with a > b. A node's neighbours are never
    gathered: each step is an aggregate of minima and a join with them."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # kept apart from the edges' own shuffle, so that the join can split the edges of a crowded node
    least = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
    large = both.join(least, "a").filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    root = large.groupBy("a").agg(F.min("b").alias("b"))
    rest = large.join(root.withColumnRenamed("b", "m"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return root.unionByName(rest).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, root (its component's least node) for every node of edges (a, b); loops are dropped."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == seen:
            break
        seen = state
        if not state.n:
            break
        now = cut(_stars(now))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
