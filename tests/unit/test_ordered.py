import random
import statistics

import pytest
from pyspark.sql import functions as F

from solvlake.operators import curves, ordered, qa, ranges

SCHEMA = "g string, x double, y double, i long"


def made(n=700, seed=4):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 5.0, *[rng.randrange(400) / 4 for _ in range(20)]]), rng.uniform(0, 60), k) for k in range(n)]


@pytest.mark.parametrize("most", [ordered.MOST, 30])
def test_scans_equal_plain_windows(spark, most):
    df = spark.createDataFrame(made(), SCHEMA)
    plain = df.createOrReplaceTempView("t") or spark.sql("""
        SELECT g, i, sum(y) OVER (PARTITION BY g ORDER BY x, i ROWS UNBOUNDED PRECEDING) AS total, last(p, true) OVER (PARTITION BY g ORDER BY x, i ROWS UNBOUNDED PRECEDING) AS seen,
          sum(new) OVER (PARTITION BY g ORDER BY x, i) AS band
        FROM (SELECT *, CASE WHEN y > 50 THEN struct(x, i) END AS p, CASE WHEN x - lag(x) OVER (PARTITION BY g ORDER BY x, i) > 0.5 THEN 1 ELSE 0 END AS new FROM t)""")
    want = {r.i: (round(r.total, 6), r.seen and tuple(r.seen), r.band) for r in plain.collect()}
    at = ordered.parted(df, ["g"], "x", most)
    assert at.cut == (most == 30)
    total = {r.i: round(r.total, 6) for r in ordered.running(at, ["x", "i"], F.col("y"), "total").collect()}
    seen = {r.i: r.seen and tuple(r.seen) for r in ordered.latest(at, ["x", "i"], F.when(F.col("y") > 50, F.struct("x", "i")), "seen").collect()}
    band = {r.i: r.band for r in curves.bands(df, ["g"], "x", "i", 0.5, most).collect()}
    assert {i: (total[i], seen[i], band[i]) for i in want} == want


@pytest.mark.parametrize("most", [ordered.MOST, 30])
def test_reversals_and_medians(spark, most):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for g in ("a", "b", None):
        own = sorted((x, i, y) for h, x, y, i in rows if h == g and x is not None)
        steps = [b[2] - a[2] for a, b in zip(own, own[1:])]
        want[g] = (len(own), sum(d > 5 for d in steps), sum(d < -5 for d in steps))
    assert {r.g: (r.n, r.ups, r.downs) for r in qa.reversals(df, ["g"], "x", "y", "i", most=most).collect()} == want
    middle = lambda vs: statistics.median(vs) if vs else None
    got = {r.g: (r.a, r.b) for r in ordered.medians(df, ["g"], {"a": F.col("x"), "b": F.col("y")}, most).collect()}
    for g in got:
        assert got[g][0] == middle([x for h, x, _, _ in rows if h == g and x is not None]) and got[g][1] == pytest.approx(middle([y for h, _, y, _ in rows if h == g]))
    one = ordered.medians(df, [], {"a": F.col("x"), "b": F.col("y")}, most).collect()
    assert [r.a for r in one] == [middle([r[1] for r in rows if r[1] is not None])] and one[0].b == pytest.approx(middle([r[2] for r in rows]))
    told = {r.g: (r.n_papers, r.n_rows, r.v_min, r.v_median, r.v_max) for r in ranges.summary(df, "i", {"v": "x"}, ("g",), most).collect()}
    for g, (papers, n, lo, mid, hi) in told.items():
        xs = [x for h, x, _, _ in rows if h == g and x is not None]
        assert papers == n == sum(h == g for h, *_ in rows) and (lo, mid, hi) == (min(xs), middle(xs), max(xs))


def test_large_groups_of_ties(spark):
    df = spark.range(100_000).select(F.lit("g").alias("g"), F.when(F.col("id") % 10 < 7, 5.0).otherwise(F.col("id") / 1.0).alias("v"))
    assert ordered.medians(df, ["g"], {"v": F.col("v")}, 1000).first().v == 5.0
    even = spark.range(200_000).select((F.col("id") * 7919 % 200_000 / 1.0).alias("v"))
    assert ordered.medians(even, [], {"v": F.col("v")}, 5000).first().v == 99_999.5


def test_a_curve_of_a_million_points(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("g").alias("g"), (F.pmod(F.xxhash64("id"), 10**7) / 1.0).alias("x"), (F.col("id") % 50).cast("double").alias("y"), F.col("id").alias("i"))
    whole, cut = (qa.reversals(df, ["g"], "x", "y", "i", most=m).first() for m in (2 * n, 1 << 16))
    assert whole == cut and cut.n == n
    a, b = (curves.bands(df, ["g"], "x", "i", 40.0, m).agg(F.max("band"), F.sum(F.xxhash64("i", "band").cast("decimal(38,0)"))).first() for m in (2 * n, 1 << 16))
    assert a == b and a[0] > 10
