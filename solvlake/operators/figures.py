"""Figure pages end to end: from page objects, words and images to series of points in data coordinates.

Pages with a filled curve are vector figures: their filled curves are grouped by colour, assembled into
markers, and placed in data coordinates where both axes can be calibrated from the numbers beside the
frame. All other pages with an image are raster figures, whose blobs are an estimate. Both give the same
tables, for all pages at once:

- markers: keys, source, group_key, marker_type, pixel_x, pixel_y, data_x, data_y, calibrated
- series: keys, source, group_key, n
- warnings: keys, warning

Pages without objects, words or images are simply absent; a page that could not be read is given as a row
of `failures` (keys, error) and becomes a warning, as does an image whose pixels do not fill it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvlake.functions.text import colour
from solvlake.operators import curves
from solvlake.sources.files import kept


@dataclass
class Figures:
    markers: DataFrame
    series: DataFrame
    warnings: DataFrame
    calibrations: DataFrame
    rasters: DataFrame


def marker_type(fill: Column) -> Column:
    return F.when(fill, "filled").otherwise("stroked")


def by_colour(objects: DataFrame) -> DataFrame:
    """Filled curves with their centre, type, and the colour that names their series."""
    return curves.filled_markers(objects).withColumn("group_key", colour(F.col("r"), F.col("g"), F.col("b"))).withColumn("marker_type", marker_type(F.col("fill")))


def warning(df: DataFrame, keys: list[str], *parts: Column | str) -> DataFrame:
    return df.select(*keys, F.concat_ws("", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("warning"))


def calibrate_axes(words: DataFrame, frames: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, axis, calibration; warnings): each frame's two axes from the numbers beside them. An axis
    without enough numbers has no calibration; one that they fit badly has one that is not ok."""
    found = curves.calibrate(curves.read_ticks(words, frames, keys), [*keys, "axis"])
    both = frames.select(*keys, F.explode(F.array(F.lit("x"), F.lit("y"))).alias("axis")).join(found, [*keys, "axis"], "left")
    unread = warning(both.filter("model IS NULL"), keys, F.col("axis"), " axis: no three numbers to read its scale from")
    poor = warning(both.filter("NOT ok"), keys, F.col("axis"), " axis: its numbers fit no scale well, error ", F.format_string("%.3g", "rms"))
    return found, unread.unionByName(poor)


def vector_figures(objects: DataFrame, words: DataFrame, keys: list[str], ordinal: str = "object_id") -> Figures:
    """The pages of objects are taken to be vector figures."""
    group = [*keys, "group_key"]
    marks = kept(curves.assemble(by_colour(objects), group, ordinal)).withColumn("marker_type", F.lit("filled"))  # read by each result
    series = marks.groupBy(*group).agg(F.count("*").alias("n")).withColumn("source", F.lit("vector"))
    low = curves.low_outliers(series, keys)
    few = warning(low, keys, "series ", F.col("group_key"), " has ", F.col("n"), " markers where the median is ", F.col("median").cast("long"))
    found, axes = calibrate_axes(words, curves.plot_frames(objects, keys), keys)
    placed = curves.place_in_data(marks, found, keys).withColumn("source", F.lit("vector"))
    return Figures(_markers(placed, keys), series.select(*group, "source", "n"), few.unionByName(axes), found, series.select(*keys).limit(0))


def raster_figures(objects: DataFrame, images: DataFrame, keys: list[str]) -> Figures:
    """The pages of objects are taken to be raster figures; images (keys, height, width, pixels) holds the
    grey pixels of each page's largest image."""
    pages = objects.select(*keys).distinct()
    framed = curves.largest_image(objects, keys)
    sound = images.filter("length(pixels) = height * width").join(framed.select(*keys), keys, "left_semi")
    blobs = curves.detect_blobs(sound, keys)
    clear = curves.raster_markers(blobs, keys)
    marks = clear.select(*keys, F.lit("raster").alias("source"), F.col("shape").alias("group_key"), "marker_type", F.col("cx").alias("pixel_x"), F.col("cy").alias("pixel_y"), *[F.lit(None).cast("double").alias(c) for c in ("data_x", "data_y")], F.lit(False).alias("calibrated"))
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    told = count(blobs, "raw").join(count(curves.marker_blobs(blobs), "shaped"), keys, "left").join(count(clear, "kept"), keys, "left").na.fill(0)
    warned = [
        warning(pages.join(framed, keys, "left_anti"), keys, "no image on the page"),
        warning(images.join(framed.select(*keys), keys, "left_semi").filter("NOT coalesce(length(pixels) = height * width, false)"), keys, "the image cannot be read"),
        warning(sound.join(told, keys, "left_anti"), keys, "no blob of a marker's size"),
        warning(told, keys, "an estimate: ", F.col("raw"), " blobs, ", F.col("shaped"), " of a marker's shape, ", F.col("kept"), " outside rows of text"),
        warning(curves.ambiguous_pages(clear, keys), keys, F.col("ambiguous"), " of ", F.col("n"), " blobs have no clear shape"),
    ]
    series = marks.groupBy(*keys, "group_key").agg(F.count("*").alias("n")).select(*keys, "group_key", F.lit("raster").alias("source"), "n")
    return Figures(_markers(marks, keys), series, reduce(DataFrame.unionByName, warned), pages.limit(0).withColumn("axis", F.lit("")), framed.select(*keys))


def _markers(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, "source", "group_key", "marker_type", "pixel_x", "pixel_y", "data_x", "data_y", "calibrated")


def extract(objects: DataFrame, words: DataFrame, images: DataFrame, keys: list[str], failures: DataFrame | None = None) -> Figures:
    """Every page by the way that suits it."""
    route = curves.vector_pages(objects, keys)
    of = lambda vector: objects.join(route.filter("is_vector" if vector else "NOT is_vector").select(*keys), keys, "left_semi")
    one, two = vector_figures(of(True), words, keys), raster_figures(of(False), images, keys)
    warned = one.warnings.unionByName(two.warnings)
    if failures is not None:
        warned = warned.unionByName(warning(failures, keys, "the page could not be read: ", F.col("error")))
    return Figures(one.markers.unionByName(two.markers), one.series.unionByName(two.series), warned, one.calibrations, two.rasters)


def document_prepass(found: Figures, pdf: str = "pdf", page: str = "page_index") -> tuple[DataFrame, DataFrame]:
    """(pages, points): pdf, page, series_counts and status (confident, unverified or raster) of the figure pages;
    and the calibrated markers of those pages that are confident and whose two axes both fit."""
    vector = curves.prepass(found.series.filter("source = 'vector'"), pdf, page)
    none = F.array().cast(vector.schema["series_counts"].dataType).alias("series_counts")
    pages = vector.unionByName(found.rasters.select(pdf, page, none, F.lit("raster").alias("status")))
    points = found.markers.filter("calibrated").join(vector.filter("status = 'confident'").select(pdf, page), [pdf, page], "left_semi")
    return pages, points
