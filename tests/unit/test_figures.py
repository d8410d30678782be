import json

import pytest
from pyspark.sql import functions as F

from solvlake.operators import curves, figures

KEYS = ["pdf", "page_index"]
OBJECT = "pdf string, page_index int, object_id long, kind string, fill boolean, r double, g double, b double, x0 double, top double, x1 double, bottom double, width double, height double"
WORD = "pdf string, page_index int, text string, x0 double, top double, x1 double, bottom double"
IMAGE = "pdf string, page_index int, height int, width int, pixels binary"


def marker(page, k, x, y, colour=(1.0, 0.0, 0.0)):
    return ("a", page, k, "curve", True, *colour, x - 2.5, y - 3.0, x + 2.5, y + 3.0, 5.0, 6.0)


def frame(page, kind="rect"):
    return ("a", page, 999, kind, False, None, None, None, 100.0, 100.0, 500.0, 400.0, 400.0, 300.0)


def word(page, text, x, y):
    return ("a", page, text, x - 4.0, y - 4.0, x + 4.0, y + 4.0)


def image(marks=(), height=120, width=400):
    pixels = bytearray([255] * height * width)
    for x, y, n in marks:
        for v in range(y, y + n):
            pixels[v * width + x : v * width + x + n] = bytes(n)
    return bytes(pixels)


@pytest.fixture(scope="module")
def pages(spark):
    """Page 0: three uniform series on two axes, one marker drawn twice. Page 1: no numbers, one low series.
    Page 2: a raster image. Page 3: text only. Page 4: an image that is cut short. Page 5: could not be read."""
    objects = [frame(0), frame(1), frame(2, "image"), ("a", 3, 1, "line", False, None, None, None, 0.0, 0.0, 5.0, 0.0, 5.0, 0.0), frame(4, "image")]
    for s, colour in enumerate([(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]):
        objects += [marker(0, 100 * s + i, 120 + 20 * i, 150 + 40 * s, colour) for i in range(10)]
        objects += [marker(1, 100 * s + i, 120 + 20 * i, 150 + 40 * s, colour) for i in range(12 if s else 4)]
    objects += [marker(0, 50, 120.1, 150.05), marker(0, 60, 300, 300, (0.5, 0.5, 0.5))]
    words = [word(0, t, x, 410) for t, x in (("1.2", 120), ("3", 300), ("5", 500))] + [word(0, t, 60, y) for t, y in (("0", 400), ("50", 250), ("100", 100))] + [word(0, "Fig", 300, 410)]
    images = [("a", 2, 120, 400, image([(20 + 40 * i, 60, 10) for i in range(5)])), ("a", 4, 120, 400, b"short")]
    failures = spark.createDataFrame([("a", 5, "bad stream")], "pdf string, page_index int, error string")
    return figures.extract(spark.createDataFrame(objects, OBJECT), spark.createDataFrame(words, WORD), spark.createDataFrame(images, IMAGE), KEYS, failures)


def test_each_page_goes_its_way(pages):
    got = {(r.page_index, r.source, r.group_key): r.n for r in pages.series.collect()}
    assert got == {(0, "vector", c): 10 for c in ("#ff0000", "#00ff00", "#0000ff")} | {(1, "vector", "#ff0000"): 4, (1, "vector", "#00ff00"): 12, (1, "vector", "#0000ff"): 12, (2, "raster", "filled_blob"): 5}


def test_markers_get_data_coordinates_where_both_axes_are_read(pages):
    first = sorted((r.data_x, r.data_y) for r in pages.markers.filter("page_index = 0 AND group_key = '#ff0000'").collect())
    assert len(first) == 10 and first[3] == pytest.approx((1.8, 100 * (400 - 150) / 300))
    assert pages.markers.filter("page_index = 0 AND NOT calibrated").count() == 0
    assert pages.markers.filter("page_index <> 0 AND (calibrated OR data_x IS NOT NULL)").count() == 0


def test_warnings(pages):
    got = {}
    for r in pages.warnings.collect():
        got.setdefault(r.page_index, []).append(r.warning)
    assert 0 not in got and 3 in got
    assert sorted(got[1]) == ["series #ff0000 has 4 markers where the median is 12", "x axis: no three numbers to read its scale from", "y axis: no three numbers to read its scale from"]
    assert got[2] == ["an estimate: 5 blobs, 5 of a marker's shape, 5 outside rows of text"]
    assert got[3] == ["no image on the page"] and got[4] == ["the image cannot be read"] and got[5] == ["the page could not be read: bad stream"]


def test_document_prepass_gates_coordinates(pages):
    told, points = figures.document_prepass(pages)
    assert {r.page_index: (r.series_counts, r.status) for r in told.collect()} == {0: ([10, 10, 10], "confident"), 1: ([12, 12, 4], "unverified"), 2: ([], "raster"), 4: ([], "raster")}
    assert {r.page_index for r in points.collect()} == {0} and points.count() == 30
    block = curves.points_json(points.withColumn("pdf", F.lit("a")), ["pdf"]).first().points
    assert {k: len(v) for k, v in json.loads(block).items()} == {"#ff0000": 10, "#00ff00": 10, "#0000ff": 10}


def test_a_badly_fitting_axis_is_told_and_not_trusted(spark):
    objects = [frame(0)] + [marker(0, i, 120 + 20 * i, 150 + 5 * (i % 2), c) for c in ((1.0, 0.0, 0.0),) for i in range(6)]
    words = [word(0, t, x, 410) for t, x in (("1", 100), ("9", 300), ("5", 500))] + [word(0, t, 60, y) for t, y in (("0", 400), ("50", 250), ("100", 100))]
    found = figures.vector_figures(spark.createDataFrame(objects, OBJECT), spark.createDataFrame(words, WORD), KEYS)
    assert found.markers.filter("calibrated").count() == 0 and found.markers.filter("data_x IS NOT NULL").count() == 6
    assert [r.warning[:35] for r in found.warnings.collect()] == ["x axis: its numbers fit no scale wel"[:35]]


def test_empty_tables(spark):
    none = [spark.createDataFrame([], s) for s in (OBJECT, WORD, IMAGE)]
    found = figures.extract(*none, KEYS)
    assert found.markers.count() == found.series.count() == found.warnings.count() == 0


def test_markers_are_assembled_once(spark):
    """The results of a page are read from its markers, which are not clustered for each of them again."""
    objects = spark.createDataFrame([(1, k, "curve", True, 1.0, 0.0, 0.0, float(10 * k), float(10 * k + 5), 10.0, 16.0, 5.0, 6.0) for k in range(4)], "page int, object_id long, kind string, fill boolean, r double, g double, b double, x0 double, x1 double, top double, bottom double, width double, height double")
    words = spark.createDataFrame([], "page int, text string, x0 double, x1 double, top double, bottom double")
    found = figures.vector_figures(objects, words, ["page"])
    for df in (found.markers, found.series, found.warnings):
        assert "applyinpandas" not in (plan := df._jdf.queryExecution().optimizedPlan().toString().lower()) and "flatmapgroups" not in plan
    assert found.series.first().n == 4
