import numpy as np
import pytest
from pyspark.sql import functions as F

from solvlake.operators import curves


def fit(spark, pixels, values):
    return curves.calibrate(spark.createDataFrame([("x", float(p), float(v)) for p, v in zip(pixels, values)], "axis string, pixel double, value double"), ["axis"]).first()


def test_calibration(spark):
    r = fit(spark, [100, 200, 300, 400], [1.5, 2.5, 3.5, 4.5])
    assert (r.model, r.n_ticks, r.ok) == ("linear", 4, True) and r.slope == pytest.approx(0.01) and r.intercept == pytest.approx(0.5) and r.r2 == pytest.approx(1)
    r = fit(spark, [0, 100, 200, 300], [0.05, 0.1414, 0.4, 1.131])
    assert r.model == "log10" and r.ok
    assert not fit(spark, range(5), [0, 1, 2, 9, 4]).ok
    assert fit(spark, [1], [2]) is None
    assert fit(spark, [1, 2], [3, 3]).ok


def objects(spark, places, size=(5.0, 6.0)):
    rows = [("p", i, "curve", True, x - size[0] / 2, y - size[1] / 2, x + size[0] / 2, y + size[1] / 2, *size) for i, (x, y) in enumerate(places)]
    return spark.createDataFrame(rows, "pdf string, object_id int, kind string, fill boolean, x0 double, top double, x1 double, bottom double, width double, height double")


def clusters(spark, places):
    made = curves.filled_markers(objects(spark, places)).withColumn("eps", F.lit(0.1) * F.hypot("width", "height"))
    return curves.single_linkage(made, ["pdf"], "cx", "cy", "eps", "object_id").select("cluster").distinct().count()


def test_close_markers_stay_apart_and_coincident_ones_merge(spark):
    assert clusters(spark, [(100, 100), (101.4, 100)]) == 2
    assert clusters(spark, [(100, 100), (100.1, 100.05)]) == 1
    assert clusters(spark, [(100 + 0.7 * i, 100) for i in range(6)]) == 1


def test_single_linkage_equals_a_plain_one(spark):
    rng = np.random.default_rng(2)
    place = rng.random((80, 2)) * 10
    df = spark.createDataFrame([("g", i, float(x), float(y), 0.9) for i, (x, y) in enumerate(place)], "g string, i int, x double, y double, eps double")
    root = list(range(80))
    for i in range(80):
        for j in range(i):
            if np.hypot(*(place[i] - place[j])) <= 0.9 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert {r.i: r.cluster for r in curves.single_linkage(df, ["g"], "x", "y", "eps", "i").collect()} == dict(enumerate(root))


def test_assemble_and_small_series(spark):
    made = curves.assemble(curves.filled_markers(objects(spark, [(10, 10), (10.1, 10), (50, 50), (90, 90)])), ["pdf"])
    assert sorted((round(r.pixel_x, 3), r.n_paths) for r in made.collect()) == [(10.05, 2), (50.0, 1), (90.0, 1)]
    assert curves.assemble(curves.filled_markers(objects(spark, [(10, 10), (50, 50)])), ["pdf"]).count() == 0


def test_frames_legends_and_routes(spark):
    df = objects(spark, [(10, 10), (60, 80)])
    assert curves.vector_pages(df, ["pdf"]).first().is_vector and not curves.vector_pages(df.withColumn("fill", F.lit(False)), ["pdf"]).first().is_vector
    frame = curves.plot_frames(df, ["pdf"]).first().frame
    assert (frame.x0, frame.bottom) == (7.5, 83.0)
    legend = df.withColumn("legend", F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("top"), F.lit(20.0).alias("x1"), F.lit(20.0).alias("bottom")))
    assert curves.filled_markers(legend).count() == 1
    box = df.withColumns({"kind": F.lit("rect"), "width": F.lit(200.0) + F.col("object_id"), "height": F.lit(90.0)})
    assert curves.plot_frames(df.unionByName(box), ["pdf"]).first().frame.x0 == 57.5


def test_ticks(spark):
    frames = spark.createDataFrame([("p", (50.0, 50.0, 350.0, 250.0))], "pdf string, frame struct<x0 double, top double, x1 double, bottom double>")
    said = [("p", t, x - 2.0, y - 2.0, x + 2.0, y + 2.0) for t, x, y in [("1", 60, 260), ("2", 160, 260), ("3.5", 260, 260), ("3.5", 260, 260), ("abc", 300, 260), ("10", 40, 60), ("20", 40, 160), ("9", 200, 150)]]
    got = curves.read_ticks(spark.createDataFrame(said, "pdf string, text string, x0 double, top double, x1 double, bottom double"), frames, ["pdf"]).collect()
    assert sorted((r.axis, r.pixel, r.value) for r in got) == [("x", 60.0, 1.0), ("x", 160.0, 2.0), ("x", 260.0, 3.5)]


def test_coordinates_need_both_axes(spark):
    markers = spark.createDataFrame([("p", "#aa", "filled", 100.0, 200.0)], "pdf string, group_key string, marker_type string, pixel_x double, pixel_y double")
    cal = spark.createDataFrame([("p", "x", "linear", 0.01, 0.5, True), ("p", "y", "log10", 0.01, -1.0, False)], "pdf string, axis string, model string, slope double, intercept double, ok boolean")
    row = curves.place_in_data(markers, cal, ["pdf"]).first()
    assert (row.data_x, row.data_y, row.calibrated) == (1.5, 10.0, False)
    assert curves.points_json(curves.place_in_data(markers, cal, ["pdf"]), ["pdf"]).first().points == '{"#aa":[[1.5,10.0]]}'
    assert curves.place_in_data(markers, cal.filter("axis = 'x'"), ["pdf"]).first().data_x is None


def test_counts_of_pages(spark):
    series = [("a", 2, 19)] * 9 + [("a", 3, n) for n in (27, 26, 12)] + [("b", 0, 3), ("b", 0, 3)]
    pages = curves.prepass(spark.createDataFrame(series, "pdf string, page_index int, n long"))
    assert {(r.pdf, r.page_index): (r.status, list(r.series_counts)) for r in pages.collect()} == {("a", 2): ("confident", [19] * 9), ("a", 3): ("unverified", [27, 26, 12])}
    assert list(curves.authoritative(pages).first().counts) == [19] * 9
    low = spark.createDataFrame([("p", "#a", 19), ("p", "#b", 19), ("p", "#c", 19), ("p", "#d", 6)], "pdf string, k string, n long")
    assert [r.k for r in curves.low_outliers(low, ["pdf"]).collect()] == ["#d"]


def test_raster(spark):
    image = np.full((120, 300), 255, dtype=np.uint8)
    for k in range(4):
        image[20 + 20 * k : 30 + 20 * k, 20 + 60 * k : 30 + 60 * k] = 0
    image[100, :] = 0  # a thin line
    for k in range(10):
        image[108:116, 10 + 20 * k : 18 + 20 * k] = 0  # a row of text
    blobs = curves.detect_blobs(spark.createDataFrame([("p", 120, 300, bytearray(image.tobytes()))], "pdf string, height int, width int, pixels binary"), ["pdf"])
    assert blobs.count() == 14
    kept = curves.raster_markers(blobs, ["pdf"]).collect()
    assert sorted((r.cx, r.cy, r.shape) for r in kept) == [(24.5 + 60 * k, 24.5 + 20 * k, "filled_blob") for k in range(4)]


def test_components_of_a_mask():
    mask = np.array([[1, 0, 1, 0], [1, 1, 1, 0], [0, 0, 0, 1], [1, 0, 0, 1]], dtype=bool)
    lab = curves._labelled(mask)
    assert lab[0, 0] == lab[0, 2] == lab[1, 1] and len({lab[0, 0], lab[2, 3], lab[3, 0]}) == 3 and lab[2, 3] == lab[3, 3] and (lab[~mask] == 0).all()


@pytest.mark.parametrize(("fill", "w", "h", "shape"), [(0.7, 10, 10, "filled_blob"), (0.3, 10, 10, "stroked_glyph"), (0.3, 20, 10, "ambiguous"), (0.5, 10, 10, "ambiguous")])
def test_blob_shapes(spark, fill, w, h, shape):
    assert spark.range(1).select(curves.blob_shape(F.lit(fill), F.lit(w), F.lit(h)).alias("s")).first().s.shape == shape
