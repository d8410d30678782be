import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from solvlake.operators import linkage
from solvlake.operators.graph import components

SCHEMA = "g string, x double, y double, eps double, i long"


def brute(rows):
    """cluster of each row, by all pairs."""
    root = {r[4]: r[4] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (g, x, y, eps, i) in enumerate(rows):
        for h, x2, y2, _, j in rows[:k]:
            if g == h and None not in (x, y, x2, y2, eps) and np.hypot(x - x2, y - y2) <= eps:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((str(r[0]), r[4], find(r[4])) for r in rows)


def made(seed=1):
    rng = random.Random(seed)
    rows = []
    for g, n, spread, eps in (("a", 200, 10, 0.5), ("b", 150, 3, 0.3), (None, 120, 100, 2.0), ("c", 60, 5, 0.0), ("d", 20, 5, None), ("e", 300, 1, 0.01)):
        for _ in range(n):
            x, y = rng.uniform(-spread, spread), rng.uniform(-spread, spread)
            if rng.random() < 0.2:
                x, y = round(x), round(y)  # points of one place
            rows.append((g, float(x), float(y), eps, len(rows)))
        # steps of the very distance
        rows += [(g, 50 + k * (eps or 1.0), 50.0, eps, len(rows) + k) for k in range(6)]
    rows += [("a", None, 1.0, 0.5, 90000), ("a", 1.0, float("nan"), 0.5, 90001), ("a", float("inf"), 1.0, 0.5, 90002), ("a", float("inf"), 1.0, 0.5, 90003)]
    return rows


def found(spark, rows, **how):
    got = linkage.single_linkage(spark.createDataFrame(rows, SCHEMA), ["g"], "x", "y", "eps", "i", **how)
    return sorted((str(r.g), r.i, r.cluster) for r in got.collect())


@pytest.mark.parametrize("how", [{}, {"local": 0}, {"local": 0, "direct": 1}, {"local": 100}])
def test_against_all_pairs(spark, how):
    assert found(spark, made(), **how) == brute(made())


def test_no_points(spark):
    for local in (0, 10):
        assert linkage.single_linkage(spark.createDataFrame([], SCHEMA), ["g"], "x", "y", "eps", "i", local=local).count() == 0


def test_dense_cells(spark):
    """Three strips of 100,000 points each across the grid; the second's border is a hair within the distance of the
    first's, the third's a hair beyond it, and the borders are the densest."""
    n, w, turn = 100_000, 0.3, 0.5
    inside, beyond = 1 - 1e-7, 1 + 1e-7
    u, v = (F.pmod(F.xxhash64("id", F.lit(k)), 10**6) / 1e6 * w for k in (1, 2))
    place, kind = F.col("id").cast("long") / 3 % 10, F.col("c")
    border = F.floor(place)
    across = F.when(kind == 0, F.when(border == 0, w).when(border == 1, 0.0).otherwise(u)).when(kind == 1, w + inside + F.when(border == 0, 0.0).otherwise(u)).otherwise(-beyond - F.when(border == 0, 0.0).otherwise(u))
    at = spark.range(3 * n).withColumn("c", (F.col("id") % 3).cast("int")).select("id", "c", across.alias("p"), v.alias("q"))
    points = at.select(F.lit("g").alias("g"), (F.col("p") * np.cos(turn) - F.col("q") * np.sin(turn)).alias("x"), (F.col("p") * np.sin(turn) + F.col("q") * np.cos(turn)).alias("y"), F.lit(1.0).alias("eps"), F.col("id").alias("i"))
    got = linkage.single_linkage(points, ["g"], "x", "y", "eps", "i").withColumn("c", F.col("i") % 3)
    assert {(r.c, r.cluster): r.n for r in got.groupBy("c", "cluster").agg(F.count("*").alias("n")).collect()} == {(0, 0): n, (1, 0): n, (2, 2): n}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(60)] + [(5, 5)]
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, a)
            root.setdefault(b, b)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}


def test_keys_named_as_columns_on_the_way(spark):
    """A group of so many points that it is clustered over the cluster; its key may be called anything."""
    rows = [("a", float(k % 50), float(k // 50), 1.0, k) for k in range(200)]
    for name in ("label", "cell", "x", "cluster_", "eps_", "n"):
        df = spark.createDataFrame(rows, f"{name} string, px double, py double, e double, i long")
        assert {r.cluster for r in linkage.single_linkage(df, [name], "px", "py", "e", "i", local=10).collect()} == {0}
