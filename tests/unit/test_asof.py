import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from solvlake.operators import asof, ordered

POINTS = "k string, x double, y double, o long"
STATED = "i long, k string, x0 double, y0 double, tolerance double"


def made(seed, n, m, keys, grid):
    rng = random.Random(seed)
    number = lambda: rng.randrange(grid) / 10 if rng.random() < 0.97 else rng.choice([None, float("nan")])
    points = [(rng.choice(keys), number(), number(), i) for i in range(n)]
    stated = [(i, rng.choice([*keys, "no points", None]), number(), number(), rng.choice([0.3, 0.3, 2.0, None, 0.0, 50.0])) for i in range(m)]
    return points, stated


def brute(points, stated):
    ok = lambda *vs: all(v is not None and v == v for v in vs)
    own = {}
    for row in stated:
        if ok(row[2], row[3]):
            own.setdefault(row[0], []).append(row)
    out = {}
    for i, rows in own.items():
        met = [(abs(x - x0), abs(y - y0), o, x, y, tol) for _, k, x0, y0, tol in rows for kk, x, y, o in points if k == kk and ok(x, y)]
        if not met:
            continue
        least = min(d[0] for d in met)
        tol = met[0][5]
        far = tol is not None and least > tol
        window = least if tol is None or far else tol
        best = min((d for d in met if d[0] <= window), key=lambda d: (d[0] if far else d[1], d[2]))
        out[i] = (least, far, best[3], best[4], best[0], best[1])
    return out


def found(spark, points, stated, most=ordered.MOST):
    got = asof.nearest(spark.createDataFrame(points, POINTS), spark.createDataFrame(stated, STATED), ["k"], ["i"], "o", most=most).collect()
    return {r.i: (r.min_dx, r.far, r.x, r.y, r.dx, r.dy) for r in got}


@pytest.mark.parametrize("most", [ordered.MOST, 40])
def test_against_all_pairs(spark, most):
    points, stated = made(1, 1500, 150, ["a", "b", "b", None], 300)
    assert found(spark, points, stated, most) == brute(points, stated)


def test_wide_ranges_and_repeated_places(spark, monkeypatch):
    monkeypatch.setattr(asof, "BLOCK_BITS", 2)
    monkeypatch.setattr(asof, "BLOCK", 4)
    points, stated = made(2, 1200, 120, ["a", "a", "b"], 40)
    assert found(spark, points, stated, 100) == brute(points, stated)


def test_a_place_under_several_keys(spark):
    points, stated = made(3, 200, 40, ["a", "b"], 100)
    both = [(i, k, x0, y0, t) for i, _, x0, y0, t in stated for k in "ab"]
    assert found(spark, points, both) == brute(points, both)


def test_edges_are_where_the_difference_is_within(spark):
    rng = np.random.default_rng(0)
    x0 = np.concatenate([rng.integers(-100, 100, 500) / 10, [0.3, 0.0, 1e9, 1e-20, -0.3]])
    tol = np.concatenate([rng.choice([0.3, 0.1, 1e-9, 7.7, 0.0], 500), [0.3, 0.0, 0.3, 0.3, 0.3]])
    for low, sign in ((True, -1), (False, 1)):
        edge = asof._edges(pd.Series(x0), pd.Series(tol), low).to_numpy()
        assert (np.abs(edge - x0) <= tol).all()
        assert (np.abs(np.nextafter(edge, sign * np.inf) - x0) > tol).all()


def test_one_crowded_key(spark):
    """A key of a million points, of which each of 500 stated places has some 40,000 within its tolerance."""
    n = 1_000_000
    points = spark.range(n).select(F.lit("k").alias("k"), (F.pmod(F.xxhash64("id"), 1_400_000) / 1e5).alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), 10**9) / 1e7).alias("y"), F.col("id").alias("o"))
    stated = spark.range(500).select("id", F.lit("k").alias("k"), (F.col("id") / 36).alias("x0"), (F.col("id") / 5 % 100).alias("y0"), F.when(F.col("id") % 5 > 0, 0.3).alias("tolerance")).withColumnRenamed("id", "i")
    got = {r.i: (r.far, r.x, r.y) for r in asof.nearest(points, stated, ["k"], ["i"], "o", most=1 << 17).collect()}
    xs, ys = (points.select(c).toPandas()[c].to_numpy() for c in "xy")
    assert len(got) == 500
    for r in stated.collect()[::7]:
        dx, dy = np.abs(xs - r.x0), np.abs(ys - r.y0)
        window = dx.min() if r.tolerance is None else r.tolerance
        at = np.flatnonzero(dx <= window)
        best = at[np.argmin(dy[at])]
        assert got[r.i] == (False, xs[best], ys[best])
