"""Curve digitisation over marker, tick and blob tables.

Rows carry keys that say which figure they belong to; every operator works on all figures at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvlake.operators import ordered
from solvlake.operators.graph import components
from solvlake.operators.linkage import clustered, single_linkage
from solvlake.sources.files import kept

# Geometry limits in points (vector) and pixels (raster).
LEAST_MARKERS, LEAST_SERIES, LEAST_TOTAL, LEAST_TICKS = 3, 2, 24, 3
UNIFORM = 0.15
RESIDUAL = 0.02
LOW_OUTLIER = 0.6
EPSILON, EPSILON_ALONE = 0.1, 0.5
SEGMENT = 12.0
FRAME_SIDE = 50.0
BLOB_AREA, BLOB_SIDE, BLOB_ASPECT = (12, 600), (6, 26), (0.55, 1.8)
ROW_GAP, ROW_BLOBS, ROW_SPACING = 8.0, 8, 36.0
INK = 128
FILLED, STROKED, STROKED_ASPECT = 0.6, 0.45, (0.6, 1.7)
AMBIGUOUS = 0.3
TICK = r"^-?\d+(\.\d+)?$"


def in_box(x: Column, y: Column, box: str) -> Column:
    """Whether a place is inside a struct column (x0, top, x1, bottom); false without a box."""
    return F.coalesce(x.between(F.col(f"{box}.x0"), F.col(f"{box}.x1")) & y.between(F.col(f"{box}.top"), F.col(f"{box}.bottom")), F.lit(False))


def centre(df: DataFrame) -> DataFrame:
    return df.withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("top") + F.col("bottom")) / 2)


def vector_pages(objects: DataFrame, keys: list[str]) -> DataFrame:
    """keys, is_vector: pages with a filled curve."""
    return objects.groupBy(*keys).agg(F.coalesce(F.bool_or((F.col("kind") == "curve") & F.col("fill")), F.lit(False)).alias("is_vector"))


def filled_markers(objects: DataFrame) -> DataFrame:
    """Filled curves with their centre, but those in the legend box, if there is a column of it."""
    found = centre(objects.filter((F.col("kind") == "curve") & F.col("fill")))
    return found.filter(~in_box(F.col("cx"), F.col("cy"), "legend")) if "legend" in objects.columns else found


def short_segments(objects: DataFrame) -> DataFrame:
    """Lines no longer than a stroked glyph's."""
    return objects.filter((F.col("kind") == "line") & (F.hypot(F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")) <= SEGMENT))


def plot_frames(objects: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frame: the largest rectangle, or else the box around all filled curves."""
    box = F.struct("x0", "top", "x1", "bottom")
    large = (F.col("kind") == "rect") & (F.col("width") > FRAME_SIDE) & (F.col("height") > FRAME_SIDE)
    filled = (F.col("kind") == "curve") & F.col("fill")
    around = F.struct(*[f(F.when(filled, F.col(c))).alias(c) for c, f in (("x0", F.min), ("top", F.min), ("x1", F.max), ("bottom", F.max))])
    own = objects.groupBy(*keys).agg(F.max_by(F.when(large, box), F.when(large, F.struct(F.col("width") * F.col("height"), -F.col("x0"), -F.col("top")))).alias("rect"), F.count_if(filled).alias("n"), around.alias("around"))
    return own.select(*keys, F.coalesce("rect", F.when(F.col("n") > 0, F.col("around"))).alias("frame")).filter("frame IS NOT NULL")


def largest_image(objects: DataFrame, keys: list[str]) -> DataFrame:
    images = objects.filter("kind = 'image'")
    return images.groupBy(*keys).agg(F.max_by(F.struct("x0", "top", "x1", "bottom"), F.struct(F.col("width") * F.col("height"), -F.col("x0"))).alias("image"))


def epsilons(markers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, eps: a tenth of the median glyph diagonal."""
    middle = ordered.medians(markers, keys, {"eps": F.hypot("width", "height")})
    return middle.withColumn("eps", F.coalesce(EPSILON * F.col("eps"), F.lit(EPSILON_ALONE)))


def centroids(points: DataFrame, clusters: DataFrame, keys: list[str], x: str, y: str, ordinal: str) -> DataFrame:
    joined = points.join(clusters, [*keys, ordinal])
    return joined.groupBy(*keys, "cluster").agg(F.avg(x).alias("pixel_x"), F.avg(y).alias("pixel_y"), F.count("*").alias("n_paths"))


def assemble(markers: DataFrame, keys: list[str], ordinal: str = "object_id") -> DataFrame:
    """One marker for each cluster of coinciding paths; series of fewer than three are dropped."""
    places = markers.select(*keys, ordinal, "cx", "cy")
    found = clustered(kept(places.join(epsilons(markers, keys), keys)), keys, "cx", "cy", "eps", ordinal)
    made = found.groupBy(*keys, "cluster").agg(F.avg("cx").alias("pixel_x"), F.avg("cy").alias("pixel_y"), F.count("*").alias("n_paths"))
    return made.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter(F.col("_n") >= LEAST_MARKERS).drop("_n")


def low_outliers(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Series with far fewer markers than their page's median; pages of three series and more."""
    w = Window.partitionBy(*keys)
    told = counts.withColumn("median", F.median(n).over(w)).withColumn("series", F.count("*").over(w))
    return told.filter((F.col("series") >= 3) & (F.col(n) < LOW_OUTLIER * F.col("median"))).drop("series")


def uniform(counts: Column) -> Column:
    """Whether an array of counts has little spread against its upper median."""
    ordered = F.sort_array(counts)
    upper = F.try_element_at(ordered, (F.size(counts) / 2).cast("int") + 1)
    return F.coalesce((F.size(counts) >= LEAST_SERIES) & (upper > 0) & (F.array_max(counts) - F.array_min(counts) <= UNIFORM * upper), F.lit(False))


def enough_ticks(ticks: DataFrame, keys: list[str], least: int = LEAST_TICKS) -> DataFrame:
    """Each tick once, of the axes that have enough of them."""
    return ticks.distinct().withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter(F.col("_n") >= least).drop("_n")


def read_ticks(words: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """keys, axis, pixel, value: numbers just outside the frame, each place once; three and more to an axis."""
    number = centre(words.filter(F.col("text").rlike(TICK))).join(frames, keys).withColumn("value", F.col("text").try_cast("double"))
    f = lambda c: F.col(f"frame.{c}")
    below = (F.col("cy") > f("bottom") - 2) & (F.col("cy") < f("bottom") + 28) & (F.col("cx") > f("x0") - 25) & (F.col("cx") < f("x1") + 25)
    left = (F.col("cx") > f("x0") - 50) & (F.col("cx") < f("x0") + 4) & (F.col("cy") > f("top") - 12) & (F.col("cy") < f("bottom") + 12)
    axes = F.array_compact(F.array(F.when(below, F.struct(F.lit("x").alias("axis"), F.col("cx").alias("pixel"))), F.when(left, F.struct(F.lit("y").alias("axis"), F.col("cy").alias("pixel")))))
    return enough_ticks(number.select(*keys, F.explode(axes).alias("t"), "value").select(*keys, "t.axis", "t.pixel", "value"), [*keys, "axis"])


def less_product(y: Column, a: Column, b: Column) -> Column:
    """y - a * b rounded once, as by a fused multiply-add: the product's and the difference's errors are added again."""
    high = lambda c: c * 134217729.0 - (c * 134217729.0 - c)  # noqa: E731  the upper half of its bits
    (ah, al), (bh, bl) = ((high(c), c - high(c)) for c in (a, b))
    p = a * b
    lost = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    d = y - p
    once = d + (((y - (d - (d - y))) + (-p - (d - y))) - lost)
    return F.when(F.abs(once) < float("inf"), once).otherwise(d)


#: Two fits are as good as each other if their errors differ by less than this share of the largest value. Such axes
#: are fitted again in the order of their ticks, if those are no more than IN_ORDER.
CLOSE, IN_ORDER = 1e-6, 10_000
_FITS = "s1 double, i1 double, s2 double, i2 double, rms1 double, rms2 double"


def _line(pairs: list[tuple[float, float]], mean: float) -> tuple[float, float]:
    """Slope and intercept by running means, a product and its sum rounded once; without a slope 0 and the mean."""
    n, x_mean, y_mean, both, square = 0, 0.0, 0.0, 0.0, 0.0
    for n, (x, y) in enumerate(pairs, 1):
        from_x, to_x, to_y = x - x_mean, x_mean + (x - x_mean) / n, y_mean + (y - y_mean) / n
        both, square = math.fma(from_x, y - to_y, both), math.fma(x - to_x, from_x, square)
        x_mean, y_mean = to_x, to_y
    if n < 2 or square == 0:
        return 0.0, mean
    slope = (both / n) / (square / n)
    return slope, math.fma(-slope, _sum(x for x, _ in pairs) / n, _sum(y for _, y in pairs) / n)


def _sum(values: Iterable[float]) -> float:
    """Added one by one, as the built-in sum adds what it lost on the way."""
    total = 0.0
    for value in values:
        total += value
    return total


def fits_in_order(ticks: list[tuple[float | None, float | None]]) -> tuple[float, ...] | None:
    """Slopes, intercepts and errors of both lines through ticks (x, v) with v > 0, taken one by one, as a serial
    aggregate takes them: its sums are the same to the last bit, where sums of parts differ."""
    known = [v for _, v in ticks if v is not None]
    pairs = [(x, v) for x, v in ticks if x is not None and v is not None]
    if not pairs:
        return None
    s1, i1 = _line(pairs, _sum(known) / len(known))
    s2, i2 = _line([(x, math.log10(v)) for x, v in pairs], _sum(map(math.log10, known)) / len(known))
    try:
        errors = [(v - (s1 * x + i1), v - math.pow(10.0, s2 * x + i2)) for x, v in pairs]
        rms1, rms2 = (math.sqrt(_sum(math.pow(e[k], 2.0) for e in errors) / len(errors)) for k in (0, 1))
    except OverflowError:  # no close fit
        return None
    return s1, i1, s2, i2, rms1, rms2


def calibrate(ticks: DataFrame, keys: list[str], pixel: str = "pixel", value: str = "value") -> DataFrame:
    """keys, model, slope, intercept, rms, r2, n_ticks, ok: a line through the ticks, or through the logarithms
    of their values if that leaves less error in data units. Axes of fewer than two ticks give no row. Where both
    lines go through all ticks, as through two, errors are those of rounding, so that an intercept is rounded once
    and axes of up to IN_ORDER ticks are fitted again tick by tick."""
    x, v = F.col(pixel), F.col(value)
    logs = F.when(v > 0, F.log10(v))
    line = lambda y, i: [F.regr_slope(y, x).alias(f"s{i}"), F.avg(F.when(y.isNotNull(), x)).alias(f"x{i}"), F.avg(F.when(x.isNotNull(), y)).alias(f"y{i}")]
    intercept = lambda i, mean: F.coalesce(less_product(F.col(f"y{i}"), F.col(f"s{i}"), F.col(f"x{i}")), F.col(mean))
    fit = ticks.groupBy(*keys).agg(
        F.count("*").alias("n_ticks"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.avg(logs).alias("log_mean"),
        *line(v, 1), *line(logs, 2),
    ).filter("n_ticks >= 2")
    fit = fit.withColumns({"i1": intercept(1, "mean"), "i2": intercept(2, "log_mean"), "s1": F.coalesce("s1", F.lit(0.0)), "s2": F.coalesce("s2", F.lit(0.0))}).drop("x1", "x2", "y1", "y2")
    each = ticks.join(fit, keys)
    e1, e2 = v - (F.col("s1") * x + F.col("i1")), v - F.pow(F.lit(10.0), F.col("s2") * x + F.col("i2"))
    l2 = logs - (F.col("s2") * x + F.col("i2"))
    square = lambda c: F.pow(c, F.lit(2.0))
    r2 = lambda res, tot: F.when(tot > 0, 1 - res / tot).otherwise(1.0)
    told = each.groupBy(*keys, "n_ticks", "low", "high", "s1", "i1", "s2", "i2").agg(
        F.sqrt(F.avg(square(e1))).alias("rms1"), F.sqrt(F.avg(square(e2))).alias("rms2"),
        r2(F.sum(square(e1)), F.sum(square(v - F.col("mean")))).alias("r1"), r2(F.sum(square(l2)), F.sum(square(logs - F.col("log_mean")))).alias("r2_"),
    )
    told = kept(told)
    close = told.filter((F.col("low") > 0) & (F.col("n_ticks") <= IN_ORDER) & ((F.col("n_ticks") == 2) | (F.abs(F.col("rms2") - F.col("rms1")) <= CLOSE * F.col("high"))))
    few = ticks.join(close.select(*keys), keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(x.cast("double").alias("x"), v.cast("double").alias("v")))).alias("ticks"))
    again = few.select(*keys, F.udf(lambda t: fits_in_order(t), _FITS)("ticks").alias("_again"))
    fields = ("s1", "i1", "s2", "i2", "rms1", "rms2")
    told = told.join(again, keys, "left").withColumns({c: F.when(F.col("_again").isNotNull(), F.col(f"_again.{c}")).otherwise(F.col(c)) for c in fields}).drop("_again")
    log = (F.col("low") > 0) & (F.col("rms2") < F.col("rms1"))
    span = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    pick = lambda a, b: F.when(log, F.col(a)).otherwise(F.col(b))
    return told.select(*keys, F.when(log, "log10").otherwise("linear").alias("model"), pick("s2", "s1").alias("slope"), pick("i2", "i1").alias("intercept"), pick("rms2", "rms1").alias("rms"), pick("r2_", "r1").alias("r2"), "n_ticks", (pick("rms2", "rms1") <= RESIDUAL * span).alias("ok"))


def to_data(pixel: Column, model: Column, slope: Column, intercept: Column) -> Column:
    straight = slope * pixel + intercept
    return F.when(model == "log10", F.pow(F.lit(10.0), straight)).otherwise(straight)


def place_in_data(markers: DataFrame, calibrations: DataFrame, keys: list[str]) -> DataFrame:
    """Adds data_x, data_y and calibrated; values only where both axes have a calibration."""
    for axis in ("x", "y"):
        cal = calibrations.filter(F.col("axis") == axis).select(*keys, *[F.col(c).alias(f"_{axis}_{c}") for c in ("model", "slope", "intercept", "ok")])
        markers = markers.join(cal, keys, "left")
    both = F.col("_x_model").isNotNull() & F.col("_y_model").isNotNull()
    made = {f"data_{a}": F.when(both, to_data(F.col(f"pixel_{a}"), F.col(f"_{a}_model"), F.col(f"_{a}_slope"), F.col(f"_{a}_intercept"))) for a in ("x", "y")}
    told = markers.withColumns(made | {"calibrated": F.coalesce(F.col("_x_ok") & F.col("_y_ok"), F.lit(False))})
    return told.drop(*[f"_{a}_{c}" for a in ("x", "y") for c in ("model", "slope", "intercept", "ok")])


def blob_shape(fill: Column, width: Column, height: Column) -> Column:
    """Struct (marker_type, shape) from a blob's geometry."""
    aspect = F.coalesce(F.try_divide(width, height), F.lit(1.0))
    of = lambda t, s: F.struct(F.lit(t).alias("marker_type"), F.lit(s).alias("shape"))
    return F.when(fill >= FILLED, of("filled", "filled_blob")).when((fill <= STROKED) & aspect.between(*STROKED_ASPECT), of("stroked", "stroked_glyph")).otherwise(of("filled", "ambiguous"))


def marker_blobs(blobs: DataFrame) -> DataFrame:
    """Blobs of a marker's area, side and aspect."""
    w, h = F.col("bbox_w"), F.col("bbox_h")
    return blobs.filter(F.col("area").between(*BLOB_AREA) & w.between(*BLOB_SIDE) & h.between(*BLOB_SIDE) & (w / h).between(*BLOB_ASPECT))


def bands(points: DataFrame, keys: list[str], along: str, ordinal: str, gap: float = ROW_GAP, most: int = ordered.MOST) -> DataFrame:
    """Adds band: a new one begins where the next value is more than gap away. Groups may be of any size."""
    return ordered.islands(ordered.parted(points, keys, along, most), [along, ordinal], gap, "band").drop(ordered.PART)


def _rows_of_text(blobs: DataFrame, keys: list[str], ordinal: str, x: str, y: str) -> DataFrame:
    """blobs with their band, its number of blobs and its median gap along x."""
    w = Window.partitionBy(*keys, "band")
    banded = bands(blobs, keys, y, ordinal).withColumn("_gap", F.col(x) - F.lag(x).over(w.orderBy(x, ordinal)))
    return banded.withColumn("_n", F.count("*").over(w)).withColumn("_gap", F.median("_gap").over(w))


def text_rows(blobs: DataFrame, keys: list[str], ordinal: str, x: str = "cx", y: str = "cy") -> DataFrame:
    """keys, band, n, median gap of the bands that are rows of text: many blobs, closely spaced."""
    told = _rows_of_text(blobs, keys, ordinal, x, y).groupBy(*keys, "band").agg(F.first("_n").alias("n"), F.first("_gap").alias("gap"))
    return told.filter((F.col("n") >= ROW_BLOBS) & (F.col("gap") < ROW_SPACING))


def without_text_rows(blobs: DataFrame, keys: list[str], ordinal: str, x: str = "cx", y: str = "cy") -> DataFrame:
    text = (F.col("_n") >= ROW_BLOBS) & (F.col("_gap") < ROW_SPACING)
    return _rows_of_text(blobs, keys, ordinal, x, y).filter(~F.coalesce(text, F.lit(False))).drop("band", "_n", "_gap")


def ambiguous_pages(blobs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, ambiguous: pages where too many blobs have no clear shape."""
    told = blobs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("shape") == "ambiguous").alias("ambiguous"))
    return told.filter(F.col("ambiguous") > AMBIGUOUS * F.col("n"))


def _united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the numbers below n that each is connected to by the pairs a[i], b[i]."""
    root = np.arange(n)
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up


def _overlaps(start: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of intervals (start, end) and disjoint, sorted intervals (starts, ends) that share a place."""
    low, high = np.searchsorted(ends, start, "right"), np.searchsorted(starts, end, "left")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(start)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Runs of a mask whose border is blank, as places row by row (start, end), and the pairs that meet in two rows."""
    flat = mask.ravel()
    edge = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    return start, end, _overlaps(start + mask.shape[1], end + mask.shape[1], start, end)


def _labelled(mask: np.ndarray) -> np.ndarray:
    """4-connected components of a mask, numbered from 1."""
    padded = np.pad(mask, 1)
    start, end, meeting = _runs(padded)
    out = np.zeros(padded.size, np.int64)
    for a, b, k in zip(start.tolist(), end.tolist(), (_united(len(start), *meeting) + 1).tolist(), strict=True):
        out[a:b] = k
    return out.reshape(padded.shape)[1:-1, 1:-1]


def opened(mask: np.ndarray) -> np.ndarray:
    """Erosion then dilation by a plus of one pixel; beyond the border there is no ink."""
    def around(m: np.ndarray, join: np.ufunc) -> np.ndarray:
        p = np.pad(m, 1)
        out = join(m, p[:-2, 1:-1])
        for beside in (p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]):
            join(out, beside, out=out)
        return out

    return around(around(mask, np.logical_and), np.logical_or)


#: Pixels of a tile's side; an opening looks two pixels beyond it.
TILE, HALO = 1024, 2
#: Pixels of the tiles that are labelled at once, where an image or a tile is no larger.
AT_ONCE = 4 << 20
_TOUCH = pa.struct([("upright", pa.bool_()), ("border", pa.int32()), ("place", pa.int32()), ("before", pa.bool_())])
_PART = "area int, x0 int, x1 int, y0 int, y1 int, lead long, touches array<struct<upright: boolean, border: int, place: int, before: boolean>>"


@dataclass
class _Tile:
    """Ink of a tile with its halo: rows from top, columns from left, of which the first `up` rows and `back` columns
    belong to the tiles beside it; the image by its number, and whether all its tiles are labelled at once."""

    ink: np.ndarray
    image: int
    top: int
    left: int
    up: int
    back: int
    rows: int
    columns: int
    height: int
    width: int
    all_here: bool


def _parts_of(tiles: list[_Tile]) -> tuple[np.ndarray, list[pa.Array]]:
    """The parts of blobs in some tiles: the images they belong to, and the columns of _PART. Runs of ink that meet, in a
    tile or at the border of two that are here, are of one part. touches: the pixels at borders, of images not all here."""
    of = {k: np.array([getattr(t, k) for t in tiles], np.int64) for k in ("image", "top", "left", "up", "back", "rows", "columns", "height", "width", "all_here")}
    span = max(t.ink.shape[1] for t in tiles) + 2
    base = np.cumsum([1, *(t.ink.shape[0] + 1 for t in tiles)])
    canvas = np.zeros((base[-1], span), bool)  # one tile below the other, with blank pixels around each
    for r, t in zip(base, tiles, strict=False):
        canvas[r : r + t.ink.shape[0], 1 : 1 + t.ink.shape[1]] = t.ink
    canvas, clean = np.zeros_like(canvas), opened(canvas)
    for r, t in zip(base, tiles, strict=False):
        own = slice(r + t.up, r + t.up + t.rows), slice(1 + t.back, 1 + t.back + t.columns)
        canvas[own] = clean[own]
    start, end, meeting = _runs(canvas)
    row = start // span
    tile = np.searchsorted(base, row, "right") - 1
    told = {k: v[tile] for k, v in of.items()}
    y, x0 = row - base[tile] - told["up"] + told["top"], start - row * span - 1 - told["back"] + told["left"]
    x1 = x0 + (end - start) - 1
    pairs = [meeting]
    sizes = np.zeros(of["image"].max() + 2, np.int64)
    sizes[of["image"] + 1] = of["height"] * of["width"]
    place = np.cumsum(sizes)[told["image"]] + y * told["width"] + x0
    sides = {  # runs at a border: upright or not, before it or behind it
        (True, True): np.flatnonzero((x1 + 1 == told["left"] + told["columns"]) & (x1 + 1 < told["width"])),
        (True, False): np.flatnonzero((x0 == told["left"]) & (x0 > 0)),
        (False, True): np.flatnonzero((y + 1 == told["top"] + told["rows"]) & (y + 1 < told["height"])),
        (False, False): np.flatnonzero((y == told["top"]) & (y > 0)),
    }
    for upright in (True, False):
        ahead, behind = sides[upright, True], sides[upright, False]
        behind = behind[np.argsort(place[behind])]
        first = place[ahead] + ((end - start)[ahead] if upright else told["width"][ahead])
        a, b = _overlaps(first, first + (1 if upright else (end - start)[ahead]), place[behind], place[behind] + (1 if upright else (end - start)[behind]))
        pairs.append((ahead[a], behind[b]))
    root = _united(len(start), *(np.concatenate(c) for c in zip(*pairs, strict=True)))
    order = np.argsort(root, kind="stable")
    names, first = np.unique(root[order], return_index=True)
    if not len(names):
        return names, []
    lead = y * told["width"] + x0
    ends = [f.reduceat(v[order], first) for f, v in ((np.add, end - start), (np.minimum, x0), (np.maximum, x1), (np.minimum, y), (np.maximum, y), (np.minimum, lead))]
    touches = []
    for (upright, before), runs in sides.items():
        runs = runs[told["all_here"][runs] == 0]
        n = np.ones(len(runs), np.int64) if upright else (end - start)[runs]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        border = (x1 if upright else y)[runs] + 1 if before else (x0 if upright else y)[runs]
        touches.append((np.repeat(root[runs], n), np.full(n.sum(), upright), np.repeat(border, n), np.repeat((y if upright else x0)[runs], n) + step, np.full(n.sum(), before)))
    owner, *fields = (np.concatenate(c) for c in zip(*touches, strict=True))
    by = np.argsort(owner, kind="stable")
    listed = pa.StructArray.from_arrays([pa.array(c[by], f.type) for c, f in zip(fields, _TOUCH, strict=True)], fields=list(_TOUCH))
    offsets = pa.array(np.searchsorted(owner[by], [*names, len(root)]), pa.int32())
    return told["image"][order][first], [*(pa.array(c, pa.int64() if k == 5 else pa.int32()) for k, c in enumerate(ends)), pa.ListArray.from_arrays(offsets, listed)]


def detect_blobs(images: DataFrame, keys: list[str], tile: int = TILE, at_once: int = AT_ONCE) -> DataFrame:
    """images: keys, height, width, pixels (8-bit grey, row by row). A row for each blob, with blob_id.

    Images are cut into tiles, of which some are labelled at once. Blobs that cross a border have a part on each side, but
    where all tiles of the image are at hand; parts meet at the pixels on both sides, and connected parts are one blob."""
    kinds = {f.name: f.dataType.simpleString() for f in images.schema.fields}
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    names = [*keys, *(c.split()[0] for c in _PART.split(", ")[:6]), "touches"]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[_Tile] = []
        owners: list[pa.RecordBatch] = []

        def told() -> Iterator[pa.RecordBatch]:
            image, columns = _parts_of(some)
            if columns:
                own = pa.Table.from_batches(owners).take(pa.array(image)).combine_chunks()
                yield pa.RecordBatch.from_arrays([*(pa.concat_arrays(c.chunks) for c in own.columns), *columns], names=names)
            some.clear()
            owners.clear()

        size = 0
        for batch in batches:
            own, sized = batch.select(keys), [batch.column(c).to_pylist() for c in ("height", "width")]
            for k, (height, width) in enumerate(zip(*sized, strict=True)):
                image = np.frombuffer(batch.column("pixels")[k].as_buffer(), np.uint8).reshape(height, width) < INK
                if some and size + image.size > at_once:
                    yield from told()
                    size = 0
                owners.append(own.slice(k, 1))
                for top in range(0, height, tile):
                    for left in range(0, width, tile):
                        high, wide = min(tile, height - top), min(tile, width - left)
                        y, x = max(0, top - HALO), max(0, left - HALO)
                        piece = image[y : top + high + HALO, x : left + wide + HALO]
                        if piece.any():
                            if some and size + piece.size > at_once and image.size > at_once:
                                yield from told()
                                owners.append(own.slice(k, 1))
                                size = 0
                            some.append(_Tile(piece, len(owners) - 1, top, left, top - y, left - x, high, wide, height, width, image.size <= at_once))
                            size += piece.size
        if some:
            yield from told()

    parts = kept(images.select(*keys, "height", "width", "pixels").mapInArrow(label, f"{named}, {_PART}").withColumn("part", F.monotonically_increasing_id()))
    border = parts.select(*keys, "part", F.inline("touches"))
    side = [*keys, "upright", "border", "place"]
    behind = border.filter("NOT before").select(*[F.col(c).alias(f"{c}_") for c in side], F.col("part").alias("b"))
    ahead = border.filter("before").withColumnRenamed("part", "a")
    behind = behind.hint("merge")  # its size is told from the list of images and not from their pixels, so it would be broadcast
    roots = components(ahead.join(behind, ordered.same(ahead, behind, side, side, "_")).select("a", "b"))
    roots = roots.hint("merge")
    crossing = parts.filter(F.size("touches") > 0)
    crossing = crossing.join(roots, crossing["part"] == roots["node"], "left").select(parts.columns + [F.coalesce("root", "part").alias("root")])
    whole = parts.filter(F.size("touches") == 0).withColumn("root", F.col("part")).unionByName(crossing).groupBy(*keys, "root")
    found = whole.agg(F.sum("area").cast("int").alias("area"), *[F.min(c).alias(c) for c in ("x0", "y0", "lead")], *[F.max(c).alias(c) for c in ("x1", "y1")]).filter(F.col("area").between(*BLOB_AREA))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("y0", "x0", "lead")) - 1  # blobs of one image
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    return found.select(*keys, number.cast("int").alias("blob_id"), ((F.col("x0") + F.col("x1")) / 2.0).alias("cx"), ((F.col("y0") + F.col("y1")) / 2.0).alias("cy"), "area", w.cast("int").alias("bbox_w"), h.cast("int").alias("bbox_h"), (F.col("area") / (w * h)).alias("fill_ratio"))


def raster_markers(blobs: DataFrame, keys: list[str]) -> DataFrame:
    """Marker-shaped blobs outside rows of text, with type and shape."""
    kept = without_text_rows(marker_blobs(blobs), keys, "blob_id")
    return kept.withColumn("_s", blob_shape(F.col("fill_ratio"), F.col("bbox_w"), F.col("bbox_h"))).select("*", "_s.marker_type", "_s.shape").drop("_s")


def prepass(series: DataFrame, pdf: str = "pdf", page: str = "page_index", n: str = "n") -> DataFrame:
    """pdf, page, series_counts (largest first), status: confident where counts are uniform, unverified
    elsewhere; pages that are no data figure are left out."""
    told = series.groupBy(pdf, page).agg(F.sort_array(F.collect_list(n), asc=False).alias("series_counts"), F.sum(n).alias("total"))
    figures = told.filter((F.size("series_counts") >= LEAST_SERIES) & (F.col("total") >= LEAST_TOTAL))
    return figures.select(pdf, page, "series_counts", F.when(uniform(F.col("series_counts")), "confident").otherwise("unverified").alias("status"))


def authoritative(pages: DataFrame, pdf: str = "pdf") -> DataFrame:
    """pdf, counts: all counts of confident pages, largest first."""
    return pages.filter("status = 'confident'").groupBy(pdf).agg(F.sort_array(F.flatten(F.collect_list("series_counts")), asc=False).alias("counts"))


def points_json(markers: DataFrame, keys: list[str], group: str = "group_key", digits: int = 4) -> DataFrame:
    """keys, points: {series: [[x, y], ...]} of the calibrated filled markers, to four significant figures."""
    from solvlake.functions.text import significant

    some = markers.filter("marker_type = 'filled' AND data_x IS NOT NULL AND data_y IS NOT NULL")
    point = F.struct(F.col("data_x").alias("o"), F.array(significant(F.col("data_x"), digits), significant(F.col("data_y"), digits)).alias("p"))
    lists = some.groupBy(*keys, group).agg(F.transform(F.array_sort(F.collect_list(point)), lambda s: s["p"]).alias("points"))
    return lists.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(group, "points"))))).alias("points"))


def prompt_block(pages: DataFrame, pdf: str = "pdf", page: str = "page_index") -> DataFrame:
    """pdf, block: one line of text for each figure page, in page order, for a reader who digitises the rest."""
    counts = F.array_join(F.transform("series_counts", lambda x: x.cast("string")), ", ")
    line = F.when(F.col("status") == "confident", F.concat_ws("", F.lit("page "), page, F.lit(" (authoritative): "), F.size("series_counts"), F.lit(" series with markers "), counts)).otherwise(F.concat_ws("", F.lit("page "), page, F.lit(" (estimate): about "), F.size("series_counts"), F.lit(" series with markers "), counts))
    lines = pages.groupBy(pdf).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), line.alias("line")))).alias("l"))
    return lines.select(pdf, F.array_join(F.col("l.line"), "\n").alias("block"))
