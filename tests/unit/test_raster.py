import numpy as np
import pytest

from solvlake.operators import curves

IMAGE = "page long, height int, width int, pixels binary"


def brute(image):
    """Blobs of a whole image by flood fill."""
    ink = curves.opened(image < curves.INK)
    seen, out = np.zeros(ink.shape, bool), []
    for y, x in zip(*np.nonzero(ink)):
        if seen[y, x]:
            continue
        todo, place = [(y, x)], []
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            place.append((a, b))
            for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                if 0 <= c < ink.shape[0] and 0 <= d < ink.shape[1] and ink[c, d] and not seen[c, d]:
                    seen[c, d] = True
                    todo.append((c, d))
        ys, xs = zip(*place)
        w, h = max(xs) - min(xs) + 1, max(ys) - min(ys) + 1
        if curves.BLOB_AREA[0] <= len(place) <= curves.BLOB_AREA[1]:
            out.append(((min(ys), min(xs), place[0][0] * ink.shape[1] + place[0][1]), ((min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2, len(place), w, h, len(place) / (w * h))))
    return [(i, *b) for i, (_, b) in enumerate(sorted(out))]


def noise(seed, height, width):
    """Blobs of every form, many of which cross borders of tiles; long lines, a frame and a spiral."""
    rng = np.random.default_rng(seed)
    image = np.full((height, width), 255, np.uint8)
    for _ in range(height * width // 250):
        y, x, h, w = rng.integers(0, height), rng.integers(0, width), rng.integers(1, 14), rng.integers(1, 14)
        image[y : y + h, x : x + w] = rng.integers(0, 200)
    image[height // 2 : height // 2 + 3, 5:-5] = 0
    return image


@pytest.mark.parametrize("tile", [8, 17, 64, 1024])
def test_tiles_agree_with_the_whole_image(spark, tile):
    images = {1: noise(1, 90, 130), 2: noise(2, 33, 200), 3: np.full((40, 40), 255, np.uint8), 4: noise(4, 1, 1), 5: noise(5, 64, 64)}
    df = spark.createDataFrame([(k, *v.shape, bytearray(v.tobytes())) for k, v in images.items()], IMAGE)
    got = {}
    for r in curves.detect_blobs(df, ["page"], tile).orderBy("page", "blob_id").collect():
        got.setdefault(r.page, []).append((r.blob_id, r.cx, r.cy, r.area, r.bbox_w, r.bbox_h, r.fill_ratio))
    assert got == {k: b for k, v in images.items() if (b := brute(v))}


def test_no_images(spark):
    assert curves.detect_blobs(spark.createDataFrame([], IMAGE), ["page"]).count() == 0


@pytest.mark.parametrize("at_once", [1, 900, 20_000])
def test_images_labelled_in_pieces(spark, at_once):
    """Blobs that cross into tiles that are labelled elsewhere, and images beside others."""
    images = {1: noise(1, 90, 130), 2: noise(2, 33, 200), 3: np.full((40, 40), 255, np.uint8), 5: noise(5, 64, 64), 6: noise(6, 20, 20)}
    df = spark.createDataFrame([(k, *v.shape, bytearray(v.tobytes())) for k, v in images.items()], IMAGE)
    got = {}
    for r in curves.detect_blobs(df, ["page"], 16, at_once).orderBy("page", "blob_id").collect():
        got.setdefault(r.page, []).append((r.blob_id, r.cx, r.cy, r.area, r.bbox_w, r.bbox_h, r.fill_ratio))
    assert got == {k: b for k, v in images.items() if (b := brute(v))}


def test_tiles_of_many_small_images_are_labelled_at_once(monkeypatch):
    """Not one tile after the other: ten pages of eight tiles take one opening."""
    calls, opened = [], curves.opened
    monkeypatch.setattr(curves, "opened", lambda mask: calls.append(1) or opened(mask))
    tiles = [curves._Tile(noise(k, 64, 64) < curves.INK, k, 0, 0, 0, 0, 64, 64, 64, 64, True) for k in range(80)]
    image, columns = curves._parts_of(tiles)
    assert len(calls) == 1 and set(image) == set(range(80)) and len(columns[0]) == len(image)
