"""As-of joins that make no pairs: the nearest point of each stated place.

Points and probes are scanned together in the order of x, which gives each point a rank within its key and
each stated place the ranks of its neighbours and of the points within its tolerance. The point that is
nearest in y among a range of ranks comes from a range tree kept as rows: ranks are grouped in blocks,
blocks in pairs, pairs in pairs and so on; a range is covered by a few blocks and groups (two a level), in
each of which a scan in the order of y finds the neighbours of the stated y. Rows grow as the points times
the levels that the widest range needs, and a range of few points is looked up rank by rank.

Keys of any size are split among tasks (see `ordered`), and every join is by key and rank or by key and
group, so that none of its keys is crowded.

Rows and values: points with a NULL or NaN place, and stated places with one, take no part. Ties go to the
least ordinal. A key without points gives no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solvlake.operators import ordered
from solvlake.sources.files import kept

#: Ranks of a block; ranges of fewer points are looked up one by one.
BLOCK_BITS = 6
BLOCK = 1 << BLOCK_BITS


def _edges(x0: pd.Series, tolerance: pd.Series, low: bool) -> pd.Series:
    """The least (or largest) x whose distance from x0, as double precision computes it, is within the
    tolerance: found by bisection, as the sum x0 + tolerance may be rounded to the other side."""
    at, width = x0.to_numpy(float), tolerance.fillna(0.0).to_numpy(float)
    sign = -1.0 if low else 1.0
    slack = 4 * np.spacing(np.maximum(np.abs(at), width))
    inside, outside = at.copy(), at + sign * (width + slack)

    def number(v: np.ndarray) -> np.ndarray:
        """Integers in the order of the doubles."""
        bits = (v + 0.0).view(np.int64)
        return np.where(bits < 0, np.int64(-(2**63)) - bits, bits)

    def double(n: np.ndarray) -> np.ndarray:
        return np.where(n < 0, np.int64(-(2**63)) - n, n).astype(np.int64).view(np.float64)

    good, bad = number(inside), number(outside)
    for _ in range(64):
        middle = (good >> 1) + (bad >> 1) + (good & bad & 1)
        fits = np.abs(double(middle) - at) <= width
        good, bad = np.where(fits, middle, good), np.where(fits, bad, middle)
    return pd.Series(double(good))


@F.pandas_udf(T.DoubleType())
def lower_edge(x0: pd.Series, tolerance: pd.Series) -> pd.Series:
    return _edges(x0, tolerance, True)


@F.pandas_udf(T.DoubleType())
def upper_edge(x0: pd.Series, tolerance: pd.Series) -> pd.Series:
    return _edges(x0, tolerance, False)


def _ranked(points: DataFrame, stated: DataFrame, keys: list[str], stated_id: list[str], ordinal: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Points with rank and the ranks first, final of the points at their x; stated places with the number of points
    before their tolerance, up to their place, and up to their tolerance's end."""
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    of_points = points.withColumns({c: F.col(c).cast("double") for c in ("x", "y")}).filter(number("x") & number("y"))
    some = stated.withColumns({c: F.col(c).cast("double") for c in ("x0", "y0", "tolerance")}).filter(number("x0") & number("y0"))
    some = some.withColumn("_s", F.monotonically_increasing_id())
    rest = [c for c in some.columns if c not in keys or c in stated_id]
    probe = lambda x, kind, name: F.struct(x.alias("x"), F.lit(kind).alias("kind"), F.lit(name).alias("probe"))
    x0, wide = F.col("x0"), F.col("tolerance").isNotNull()
    probes = F.array(probe(F.when(wide, lower_edge(x0, "tolerance")).otherwise(x0), 0, "low"), probe(x0, 2, "here"), probe(F.when(wide, upper_edge(x0, "tolerance")).otherwise(x0), 2, "high"))
    asked = some.select(*keys, F.struct(*rest).alias("s"), F.explode(probes).alias("p")).select(*keys, "s", "p.*")
    events = of_points.select(*keys, "x", "y", F.col(ordinal).alias("o"), F.lit(1).alias("kind")).unionByName(asked, allowMissingColumns=True)
    at = ordered.parted(events, keys, "x", most, points.select(*keys).unionByName(stated.select(*keys)))
    counted = ordered.running(at, ["x", "kind", "o"], (F.col("kind") == 1).cast("long"), "rank")
    ties, own = Window.partitionBy(*keys, ordered.PART, "x"), F.when(F.col("kind") == 1, F.col("rank"))
    counted = kept(counted.select(*keys, "x", "y", "o", "kind", "probe", "s", "rank", F.min(own).over(ties).alias("first"), F.max(own).over(ties).alias("final")))
    ranked = counted.filter("kind = 1").select(*keys, "x", "y", "o", "rank", "first", "final")
    count = lambda name: F.max(F.when(F.col("probe") == name, F.col("rank"))).alias(name)
    places = counted.filter("kind <> 1").groupBy(*keys, F.col("s._s").alias("_s")).agg(F.first("s").alias("s"), count("low"), count("here"), count("high"))
    return ranked, places


def _nodes(low: Column, high: Column, levels: int) -> Column:
    """The groups (level, node) that cover blocks low to high (exclusive): where a border of the range is
    odd on a level, one group of that level."""
    out = []
    for k in range(levels + 1):
        left, right = -F.shiftright(-low, k), F.shiftright(high, k)
        odd = left % 2 == 1
        group = lambda n, k=k: F.struct(F.lit(k).alias("level"), n.alias("node"))
        out.append(F.when(odd & (left < right), group(left)))
        out.append(F.when((right % 2 == 1) & (F.when(odd, left + 1).otherwise(left) < right), group(right - 1)))
    return F.array_compact(F.array(*out))


def _in_groups(ranked: DataFrame, wide: DataFrame, keys: list[str], levels: int, most: int) -> DataFrame:
    """_s and, for each group of a stated place's range, the points next to its y."""
    block = F.shiftright(F.col("rank") - 1, BLOCK_BITS)
    spots = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(block, k).alias("node")) for k in range(levels + 1)])
    asked = wide.select(*keys, "s", F.explode(_nodes(F.ceil((F.col("a") - 1) / BLOCK).cast("long"), F.shiftright(F.col("b"), BLOCK_BITS), levels)).alias("g")).select(*keys, "g.level", "g.node", "s")
    asked = kept(asked)
    group = [*keys, "level", "node"]
    spread = ranked.select(*keys, "x", "y", "o", F.explode(spots).alias("g")).select(*keys, "g.level", "g.node", "x", "y", "o")
    wanted = kept(asked.select(*group).distinct())
    here = spread.join(wanted, ordered.same(spread, wanted, group, group), "left_semi")
    # of points with one y the one with the least ordinal
    here = here.groupBy(*group, "y").agg(F.min(F.struct("o", "x")).alias("p")).select(*group, "y", F.struct("y", "p.o", "p.x").alias("p"), F.lit(1).alias("kind"))
    events = kept(here.unionByName(asked.select(*group, F.col("s.y0").alias("y"), F.lit(2).alias("kind"), "s"), allowMissingColumns=True))
    at = ordered.parted(events, group, "y", most)
    below = ordered.latest(at, ["y", "kind"], F.col("p"), "near")
    above = ordered.latest(at, [F.desc("y"), "kind"], F.col("p"), "near", descending=True)
    both = below.unionByName(above).filter("kind = 2 AND near IS NOT NULL")
    return both.select("s", "near.x", "near.y", F.col("near.o").alias("o"))


def nearest(points: DataFrame, stated: DataFrame, keys: list[str], stated_id: list[str], ordinal: str, most: int = ordered.MOST) -> DataFrame:
    """stated_id, min_dx, far, x, y, dx, dy: for each stated (x0, y0), of the points with its keys that lie within
    its tolerance of x0 the one with the nearest y. Where none does it is far, and the point with the nearest
    x is given. Where the tolerance is NULL, the points at the least distance are taken.

    points: keys, x, y, ordinal. stated: stated_id, keys, x0, y0, tolerance. A stated place may stand under
    several keys, as rows with one stated_id; all their points count together."""
    ranked, places = _ranked(points, stated, keys, stated_id, ordinal, most)
    beside = places.select(*keys, "_s", "s", "low", "high", F.explode(F.array("here", F.col("here") + 1)).alias("at"))
    met = _by_rank(beside, ranked, keys, "at", [F.col("x"), F.col("first"), F.col("final")])
    met = met.withColumn("dx", F.abs(F.col("x") - F.col("s.x0")))
    sides = met.groupBy(*keys, "_s").agg(F.first("s").alias("s"), F.first("low").alias("low"), F.first("high").alias("high"), F.min("dx").alias("own"), F.collect_list(F.struct("dx", "first", "final")).alias("sides"))  # two at most
    # the least distance over all keys that a stated place stands under
    told = sides.withColumn("min_dx", F.min("own").over(Window.partitionBy(*[F.col(f"s.{c}") for c in stated_id])))
    told = told.withColumn("far", F.coalesce(F.col("min_dx") > F.col("s.tolerance"), F.lit(False)))
    tied = F.filter("sides", lambda s: s["dx"] == F.col("min_dx"))
    span = F.when(~F.col("far") & F.col("s.tolerance").isNotNull(), F.struct((F.col("low") + 1).alias("a"), F.col("high").alias("b")))
    span = span.when(~F.col("far") & (F.size(tied) > 0), F.struct(F.array_min(F.transform(tied, lambda s: s["first"])).alias("a"), F.array_max(F.transform(tied, lambda s: s["final"])).alias("b")))
    # far ones: the first point, which has the least ordinal, at each of the nearest places
    told = told.withColumn("span", span).withColumn("ranks", F.when(F.col("far"), F.transform(tied, lambda s: s["first"])))
    told = kept(told.select(*keys, F.struct("s.*", "min_dx", "far").alias("s"), "span.a", "span.b", "ranks"))
    length = F.col("b") - F.col("a") + 1
    widest = told.agg(F.max(length)).first()[0] or 0
    wide = length >= 2 * BLOCK
    # what no whole block covers, rank by rank
    inner_a, inner_b = F.ceil((F.col("a") - 1) / BLOCK).cast("long") * BLOCK + 1, F.shiftright("b", BLOCK_BITS) * BLOCK
    each = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    ranks = F.when(F.col("ranks").isNotNull(), F.col("ranks")).when(wide, F.concat(each(F.col("a"), inner_a - 1), each(inner_b + 1, F.col("b")))).otherwise(each(F.col("a"), F.col("b")))
    single = told.select(*keys, "s", F.explode(ranks).alias("at"))
    found = _by_rank(single, ranked, keys, "at", [F.col("x"), F.col("y"), F.col("o")]).select("s", "x", "y", "o")
    if widest >= 2 * BLOCK:
        levels = max(0, int(widest // BLOCK).bit_length() - 1)
        found = found.unionByName(_in_groups(ranked, told.filter(wide), keys, levels, most).select("s", "x", "y", "o"))
    dx, dy = F.abs(F.col("x") - F.col("s.x0")), F.abs(F.col("y") - F.col("s.y0"))
    best = found.select(*[F.col(f"s.{c}").alias(c) for c in stated_id], "s.min_dx", "s.far", "x", "y", dx.alias("dx"), dy.alias("dy"), "o")
    best = best.groupBy(*stated_id, "min_dx", "far").agg(F.min_by(F.struct("x", "y", "dx", "dy"), F.struct(F.when(F.col("far"), F.col("dx")).otherwise(F.col("dy")), F.col("o"))).alias("b"))
    return best.select(*stated_id, "min_dx", "far", "b.x", "b.y", "b.dx", "b.dy")


def _by_rank(asked: DataFrame, ranked: DataFrame, keys: list[str], at: str, wanted: list[Column]) -> DataFrame:
    """asked with columns of the point of its keys with its rank."""
    right = ranked.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("rank").alias("rank_"), *wanted)
    return asked.join(right, ordered.same(asked, right, keys, keys, "_") & (asked[at] == right["rank_"])).drop(at, "rank_", *[f"{k}_" for k in keys])
