"""Queries on inputs that are larger than the driver's tables in one respect."""

import random
from fractions import Fraction

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from solvlake import queries
from solvlake.operators import curves


def test_previews_name_the_least_doi_as_text(spark, tmp_path):
    """Numbers of four and of five digits: the later page's DOI is the lesser text."""
    docs = [(17998, "same", 4), (18000, "same", 4), (2, "other", 3000)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.n_pages: (r.doi, r.status) for r in queries.QUERIES["x1_previews"](spark, str(tmp_path)).collect()}
    assert got == {2: ("10.10000/x", "new"), 1: ("10.1001/x", "existing (paper_id=2)")}


def test_centroids_of_a_large_label(spark, tmp_path):
    """A label of more points than one task clusters; the key's name is that of a column on the way."""
    points = spark.range(2100).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 3).cast("float"), F.lit(0.5).cast("float")).alias("embedding"), F.lit(0).alias("label"))
    points.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, queries.QUERIES["a14_centroids"](spark, str(tmp_path)).collect()))
    assert got == [(0, k, float(k), 0.5, 700) for k in range(3)]


def test_axes_of_two_distant_ticks(spark):
    """Two ticks far out: both lines are exact but for rounding, and the intercepts are rounded once."""
    high, low = 23.31, 20.49
    first = {6476: 473757, 31976: 2173757, 46976: 3173757, 49976: 3373757}
    ticks = [(k, float(x + d), v) for k, x in first.items() for d, v in ((0, high), (4547, low))]
    got = {r.axis: r for r in curves.calibrate(spark.createDataFrame(ticks, "axis long, pixel double, value double").coalesce(1), ["axis"]).collect()}
    # as by the query's SQL
    assert {k: r.model for k, r in got.items()} == {6476: "linear", 31976: "log10", 46976: "linear", 49976: "log10"}
    for k, x in first.items():
        if got[k].model == "linear":
            assert got[k].intercept == float(Fraction((high + low) / 2) - Fraction(got[k].slope) * Fraction(x + 4547 / 2))


def test_exact_axes_are_fitted_in_the_order_of_their_ticks(spark):
    """Both lines go through all ticks; the models are those of the query's SQL in one thread, however rows are dealt."""
    rng = random.Random(4)
    values = {k: [round(rng.expovariate(0.02) + 0.01, 2) for _ in range(2)] if k % 2 else [round(rng.expovariate(0.02) + 0.01, 2)] * 5 for k in range(400)}
    rows = sorted((rng.randrange(4_000_000), k, v) for k, vs in values.items() for v in vs)
    table = pa.table({"event_id": [r[0] for r in rows], "user_id": [r[1] for r in rows], "event_type": ["click"] * len(rows), "value": [r[2] for r in rows]})
    with duckdb.connect(config={"threads": 1}) as db:
        db.register("events", table)
        want = {r[0]: r[1] for r in db.sql(f"SELECT user_id, model FROM ({queries.FIT})").fetchall()}
    ticks = spark.createDataFrame([(k, float(x), v) for x, k, v in rows], "axis long, pixel double, value double").repartition(7)
    assert {r.axis: r.model for r in curves.calibrate(ticks, ["axis"]).collect()} == want
