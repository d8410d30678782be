"""Single linkage in the plane, for groups of any size.

A group's plane is cut into cells a little narrower than eps / sqrt(2), so that all points of a cell are
linked and a cluster is a connected set of cells. Two cells are linked if some pair of their points is
within eps. Which are is found without making all pairs: cells meet their neighbours (twelve each) with
the boxes around their points. Boxes that are apart by more than eps are not linked, boxes whose farthest
corners are within eps are. Of the rest, cells of few points compare them; the others are cut into sixteen
boxes each, and the pairs of those that are still open are cut again, until a box holds few points.
Points of one place are one point, so this ends.

Comparisons of boxes agree with those of points, as differences and hypot are monotone in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvlake.operators.graph import components
from solvlake.operators.ordered import same
from solvlake.sources.files import kept

#: Groups of so many points are clustered in one task each.
LOCAL = 2048
#: Boxes whose numbers of points have at most this product are compared point by point.
DIRECT = 1024
#: Levels of boxes; those of the last one are compared point by point.
DEEPEST = 24
#: Cells are this much narrower than eps / sqrt(2), against rounding.
NARROWER = 0.5**0.5 * (1 - 1e-9)
_BOX = ("x0", "x1", "y0", "y1")


def _stretches(points: DataFrame, keys: list[str], along: str, name: str) -> DataFrame:
    """points with the number of their stretch: the next one begins where the next value is more than eps away, so that
    no link crosses. Groups of a bounded size."""
    w = Window.partitionBy(*keys).orderBy(along)
    new = F.when(F.col(along) - F.lag(along).over(w) <= F.col("eps"), 0).otherwise(1)
    return points.withColumn("new_", new).withColumn(name, F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("new_")


def _locally(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, o, x, y, cluster of groups of a bounded size. Most points of most groups are alone in a stretch of one of the
    two axes, and are told by windows; what is left of a group is clustered in one task."""
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    counted = _stretches(points, keys, "x", "sx").withColumn("n", F.count("*").over(Window.partitionBy(*keys, "sx")))
    alone = lambda df: df.select(*keys, "o", "x", "y", F.col("o").alias("cluster"))
    told = alone(counted.filter("n = 1"))
    counted = _stretches(counted.filter("n > 1").drop("n"), [*keys, "sx"], "y", "sy").withColumn("n", F.count("*").over(Window.partitionBy(*keys, "sx", "sy")))
    told = told.unionByName(alone(counted.filter("n = 1")))
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"o {kinds['o']}", "x double", "y double", f"cluster {kinds['o']}"])

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o").reset_index(drop=True)
        place, reach = pdf[["x", "y"]].to_numpy(float), float(pdf["eps"].iloc[0])
        root = np.arange(len(pdf))
        for lo in range(0, len(pdf), 256):
            near = np.hypot(*(place[lo : lo + 256, None, :] - place[None, :, :]).transpose(2, 0, 1)) <= reach
            a, b = np.nonzero(near)
            a = a + lo
            while True:
                one, two = root[a], root[b]
                apart = one != two
                if not apart.any():
                    break
                np.minimum.at(root, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
                while not np.array_equal(up := root[root], root):
                    root = up
        return pdf[[*keys, "o", "x", "y"]].assign(cluster=pdf["o"].to_numpy()[root])

    return told.unionByName(counted.filter("n > 1").drop("n").groupBy(*keys, "sx", "sy").applyInPandas(lambda pdf: group(pdf), schema))


def _bounds() -> list[Column]:
    return [F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]


def _between(a: str, b: str) -> tuple[Column, Column]:
    """The least and the largest distance that points of two boxes can have."""
    c = lambda s, n: F.col(f"{s}.{n}")
    gap = lambda n: F.greatest(c(b, f"{n}0") - c(a, f"{n}1"), c(a, f"{n}0") - c(b, f"{n}1"), F.lit(0.0))
    reach = lambda n: F.greatest(c(b, f"{n}1") - c(a, f"{n}0"), c(a, f"{n}1") - c(b, f"{n}0"))
    return F.hypot(gap("x"), gap("y")), F.hypot(reach("x"), reach("y"))


def _spot(level: int) -> list[Column]:
    """Row and column of a place's box on a level: each has sixteen on the next."""
    return [F.floor(F.col(c) * float(4**level)).alias(f"{c}_") for c in ("u", "v")]


def _judge(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of boxes that are linked, and the pairs of boxes that are open."""
    least, most = _between("left", "right")
    told = met.withColumn("least", least).filter(F.col("least") <= F.col("eps")).withColumn("linked", most <= F.col("eps")).drop("least")
    return told.filter("linked").select("a", "b"), told.filter("NOT linked").drop("linked")


def _side(df: DataFrame, boxes: DataFrame, side: str, cell: str, names: list[str]) -> DataFrame:
    """df with the rows of boxes that are in its box of one side, as a struct `<side>_`."""
    right = boxes.select(F.col("cell").alias("cell_"), *[F.col(n).alias(f"_{n}") for n in names], F.struct(*[c for c in boxes.columns if c not in ("cell", *names)]).alias(f"{side}_"))
    on = (df[cell] == right["cell_"]) & (df[side]["u_"] == right[f"_{names[0]}"]) & (df[side]["v_"] == right[f"_{names[1]}"])
    return df.join(right, on).drop("cell_", *[f"_{n}" for n in names])


def _links(places: DataFrame, cells: DataFrame, keys: list[str], direct: int) -> DataFrame:
    """a, b: cells with points within eps of each other. places: cell, x, y, u, v."""
    box = F.struct("u_", "v_", "n", *_BOX)
    ahead = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    left = cells.select(*keys, F.col("cell").alias("a"), "eps", box.alias("left"), F.inline(F.array(*[F.struct((F.col("u_") + i).alias("lu"), (F.col("v_") + j).alias("lv")) for i, j in ahead])))
    right = cells.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("u_").alias("ru"), F.col("v_").alias("rv"), F.col("cell").alias("b"), box.alias("right"))
    met = left.join(right, same(left, right, keys, keys, "_") & (F.col("lu") == F.col("ru")) & (F.col("lv") == F.col("rv")))
    linked, open_ = _judge(met.select("a", "b", "eps", "left", "right"))
    found, open_ = linked.distinct(), kept(open_)
    for level in range(DEEPEST + 1):
        few = F.col("left.n") * F.col("right.n") <= direct if level < DEEPEST else F.lit(True)
        spots = places.select("cell", F.struct("x", "y").alias("at"), *_spot(level))
        pairs = _side(_side(open_.filter(few), spots, "left", "a", ["u_", "v_"]), spots, "right", "b", ["u_", "v_"])
        apart = F.hypot(F.col("left_.at.x") - F.col("right_.at.x"), F.col("left_.at.y") - F.col("right_.at.y"))
        found = kept(found.unionByName(pairs.filter(apart <= F.col("eps")).select("a", "b").distinct()))
        many = open_.filter(~few).join(found, ["a", "b"], "left_anti")
        if many.isEmpty():
            break
        above = [c.alias(f"{n}up") for c, n in zip(_spot(level), "uv", strict=True)]
        parts = places.select("cell", "x", "y", *above, *_spot(level + 1)).groupBy("cell", "uup", "vup", "u_", "v_").agg(*_bounds())
        cut = many.select("a", "b", "eps", "left", "right")
        cut = _side(_side(cut, parts, "left", "a", ["uup", "vup"]), parts, "right", "b", ["uup", "vup"])
        linked, open_ = _judge(cut.select("a", "b", "eps", F.col("left_").alias("left"), F.col("right_").alias("right")))
        linked = kept(linked.distinct())
        found, open_ = found.unionByName(linked), kept(open_.join(linked, ["a", "b"], "left_anti"))
    return found


def _widely(points: DataFrame, keys: list[str], direct: int) -> DataFrame:
    """keys, o, x, y, cluster of groups of any size."""
    finite = lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))  # noqa: E731  neither NULL nor NaN either
    side = F.col("eps") * NARROWER
    usable = finite(F.col("x")) & finite(F.col("y")) & finite(F.col("eps"))
    sure = points.filter(usable & (F.col("eps") > 0)).withColumns({"u": F.col("x") / side, "v": F.col("y") / side})
    sure = sure.withColumns(dict(zip(("u_", "v_"), _spot(0), strict=True)))
    spot = [*keys, "u_", "v_"]
    places = sure.groupBy(*spot, "x", "y").agg(F.min("o").alias("first"), *[F.first(c).alias(c) for c in ("eps", "u", "v")])
    cells = places.groupBy(*spot).agg(F.min("first").alias("label"), F.first("eps").alias("eps"), *_bounds())
    cells = kept(cells.withColumn("cell", F.monotonically_increasing_id()))
    names = cells.select(*[F.col(c).alias(f"{c}of") for c in spot], "cell")
    placed = kept(places.join(names, same(places, names, spot, spot, "of")).select("cell", "x", "y", "u", "v"))
    roots = components(_links(placed, cells, keys, direct))
    told = cells.select(*spot, "cell", "label").join(roots, F.col("cell") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cell")).drop("node")
    least = kept(told.groupBy("root").agg(F.min("label").alias("cluster")))
    named = kept(told.join(least, "root").select(*[F.col(c).alias(f"{c}of") for c in spot], "cluster"))
    some = sure.join(named, same(sure, named, spot, spot, "of")).select(*keys, "o", "x", "y", "cluster")
    # with a distance of 0 only points of one place are linked, and without a place or a distance none are
    rest = points.filter(~(usable & (F.col("eps") > 0)))
    still = rest.filter(usable & (F.col("eps") == 0))
    place = [*keys, "x", "y"]
    first = kept(still.groupBy(*place).agg(F.min("o").alias("cluster")).withColumnsRenamed({c: f"{c}of" for c in place}))
    none = rest.filter(~(usable & (F.col("eps") == 0))).select(*keys, "o", "x", "y", F.col("o").alias("cluster"))
    return some.unionByName(still.join(first, same(still, first, place, place, "of")).select(*keys, "o", "x", "y", "cluster")).unionByName(none)


def clustered(points: DataFrame, keys: list[str], x: str, y: str, eps: str, ordinal: str, local: int = LOCAL, direct: int = DIRECT) -> DataFrame:
    """keys, ordinal, cluster as by single_linkage, and x and y in double precision."""
    own = [f"key{i}_" for i in range(len(keys))]  # keys may have any names, also those used here
    some = points.select(*[F.col(k).alias(n) for k, n in zip(keys, own, strict=True)], F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(eps).cast("double").alias("eps"), F.col(ordinal).alias("o"))
    sizes = some.groupBy(*own).agg(F.count("*").alias("n")).filter(F.col("n") > local)
    large = kept(sizes.select(*[F.col(k).alias(f"{k}of") for k in own], F.lit(True).alias("is_large")))
    if large.isEmpty():
        made = _locally(some, own)
    else:
        in_large = same(some, large, own, own, "of")
        made = _locally(some.join(large, in_large, "left_anti"), own).unionByName(_widely(some.join(large, in_large, "left_semi"), own, direct))
    return made.select(*[F.col(n).alias(k) for k, n in zip(keys, own, strict=True)], F.col("o").alias(ordinal), "cluster", F.col("x").alias(x), F.col("y").alias(y))


def single_linkage(points: DataFrame, keys: list[str], x: str, y: str, eps: str, ordinal: str, local: int = LOCAL, direct: int = DIRECT) -> DataFrame:
    """keys, ordinal, cluster (its least ordinal): points of a group are in one cluster if steps of at most eps, which
    is one number for a group, join them. A point without a place, or without an eps, is alone. Groups of at most
    `local` points are clustered in a task each; larger ones over the cluster."""
    return clustered(points, keys, x, y, eps, ordinal, local, direct).select(*keys, ordinal, "cluster")
