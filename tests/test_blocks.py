"""Windows as arrays: what a detector sees, and how often."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seasight.operators import blocks, scene
from seasight.settings import Settings
from seasight.sources import rasters

PX = "image long, r long, c long, green double, red double, rededge2 double, nir double, swir1 double, scl long"
WATER = (0.025, 0.015, 0.005, 0.003, 0.001)
PATCH = (0.035, 0.018, 0.012, 0.030, 0.004)


def sea(h, w, patches=()):
    """Rows of a pixel table: water with a little noise, and bright patches (r0, r1, c0, c1)."""
    for r in range(h):
        for c in range(w):
            hit = any(a <= r < b and x <= c < y for a, b, x, y in patches)
            v = PATCH if hit else (*WATER[:3], 0.003 + (r * 31 + c * 17) % 10 * 1e-5, WATER[4])
            yield (0, r, c, *v, 6)


def thresholds():
    """A detector's function, made here so that workers need not import this module."""

    def find(bands):
        hit = bands["nir"] > 0.02
        if hit.any():
            r, c = np.nonzero(hit)
            yield float(c.min()), float(r.min()), float(c.max() + 1), float(r.max() + 1), "marine_debris", 0.8

    return find


def test_a_detector_sees_the_patch_once_a_window(spark, tmp_path):
    """It thresholds real bands; each accepted window is seen once, however often the result is used."""
    px = spark.createDataFrame(list(sea(128, 128, [(80, 87, 90, 96), (10, 16, 100, 109)])), PX)

    bright = thresholds()

    def counted(bands):
        assert bands["nir"].shape == (64, 64) and set(bands) == {"green", "red", "rededge2", "nir", "swir1", "scl"}
        (tmp_path / uuid.uuid4().hex).touch()
        yield from bright(bands)

    found, tiles = scene.detect(px, blocks.per_window(counted), 128, 128, Settings(tile_size=64, tile_overlap=0), percentile=0.9, scene_id="x")
    got = sorted((r["xmin"], r["ymin"], r["xmax"], r["ymax"]) for r in found.collect())
    assert got == [(90.0, 80.0, 96.0, 87.0), (100.0, 10.0, 109.0, 16.0)]
    assert found.count() == 2 and scene.summary(found, tiles).startswith("2 detections | 2/4 windows")
    assert len(list(tmp_path.iterdir())) == 2


def test_a_patch_at_a_seam_comes_once(spark):
    px = spark.createDataFrame(list(sea(64, 112, [(20, 27, 52, 60)])), PX)
    found, _ = scene.detect(px, blocks.per_window(thresholds()), 112, 64, Settings(tile_size=64, tile_overlap=16), screened=False)
    assert [(r["xmin"], r["ymin"], r["xmax"], r["ymax"]) for r in found.collect()] == [(52.0, 20.0, 60.0, 27.0)]


@pytest.mark.parametrize(("most", "size", "overlap"), [(7, 16, 5), (1024, 10, 0), (1, 64, 3)])
def test_blocks_are_slices(spark, most, size, overlap):
    """Of scenes with holes and pixels without data, also where stretches are cut, windows short, and bands whole numbers."""
    r = np.random.default_rng(1)
    a, b = r.normal(size=(2, 23, 37)), r.integers(0, 9, (2, 23, 37))
    a[r.random(a.shape) < 0.1] = np.nan
    rows = [(i, y, x, None if np.isnan(a[i, y, x]) else float(a[i, y, x]), int(b[i, y, x])) for i in range(2) for y in range(23) for x in range(37) if (y, x) != (5, 6)]
    px = spark.createDataFrame(rows, "image long, r long, c long, a double, b int").repartition(3)
    a[:, 5, 6], b = np.nan, b.astype(float)
    b[:, 5, 6] = np.nan
    step = size - overlap
    offs = [(y, x) for y in range(0, max(1, 23 - size + step), step) for x in range(0, max(1, 37 - size + step), step)]
    windows = spark.createDataFrame([(i, *o) for i in range(2) for o in offs], "image long, row_off long, col_off long")
    got = blocks.blocks(blocks.stretches(px, ["a", "b"], most), windows, 37, 23, size, overlap, "float64").collect()
    assert len(got) == 2 * len(offs)
    for g in got:
        at = blocks.arrays(g)
        y, x = slice(g["row_off"], g["row_off"] + size), slice(g["col_off"], g["col_off"] + size)
        np.testing.assert_array_equal(at["a"], a[g["image"], y, x])
        np.testing.assert_array_equal(at["b"], b[g["image"], y, x])


def test_detection_from_files(spark, tmp_path):
    """Bands of a file go to the detector as stretches; what it finds has its evidence from the same bands."""
    planes = {n: np.full((64, 96), round(v * 10000), "uint16") for n, v in zip(("B03", "B04", "B06", "B08", "B11"), WATER)} | {"SCL": np.full((64, 96), 6, "uint16")}
    for n, v in zip(("B03", "B04", "B06", "B08", "B11"), PATCH):
        planes[n][30:38, 70:80] = round(v * 10000)
    (tmp_path / "s.tif").write_bytes(rasters.encode(planes, (10.0, 0.0, 5e5, 0.0, -10.0, 4e6), 32633))
    bands = {"B03": "green", "B04": "red", "B06": "rededge2", "B08": "nir", "B11": "swir1", "SCL": "scl"}
    rows = rasters.read_rows(spark, f"file://{tmp_path}")
    found, tiles = scene.detect_rows(rows, blocks.per_window(thresholds()), bands, Settings(tile_size=64, tile_overlap=0), scale=1e-4, percentile=0.5)
    got = found.collect()
    assert sorted((r["xmin"], r["ymin"], r["xmax"], r["ymax"]) for r in got) == [(70.0, 30.0, 80.0, 38.0)]
    assert got[0]["fdi"] > 0.006 and tiles.filter("accepted").count() == 1
    px = blocks.pixels(blocks.from_rows(rows.select(F.lit(1).cast("long").alias("image"), "r", "c0", "band", "values")), ["B08"])
    assert px.count() == 64 * 96 and px.agg(F.sum("B08")).first()[0] == int(planes["B08"].sum())


def test_images_of_bytes():
    grey = np.array([[0, 255], [7, 9]], "uint8")
    assert (blocks.as_uint8(grey) == grey[..., None]).all() and blocks.as_uint8(grey).shape == (2, 2, 3)
    assert blocks.as_uint8(np.array([[[0.0, 0.5, 1.0, 0.3]]])).tolist() == [[[0, 128, 255]]]
    assert blocks.as_uint8(np.array([[300.0, -4.0, np.nan]])).tolist() == [[[255] * 3, [0] * 3, [0] * 3]]
    with pytest.raises(ValueError):
        blocks.as_uint8(np.zeros((2, 2, 2)))
    ramp = np.arange(101.0).reshape(1, 101)
    out = blocks.rgb({"red": ramp, "green": np.full((1, 101), 3.0)}, low=0, high=100)
    assert out[0, [0, 100], 0].tolist() == [0, 255] and set(out[..., 1].ravel()) == {128} and not out[..., 2].any()


def test_detectors_get_few_windows_at_a_time(spark):
    """And may return nothing; the session's batches are what they were."""
    px = spark.createDataFrame(list(sea(40, 40)), PX)
    windows = spark.createDataFrame([(0, y, x) for y in range(0, 40, 8) for x in range(0, 40, 8)], "image long, row_off long, col_off long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    b = blocks.blocks(blocks.stretches(px, ["nir"]), windows, 40, 40, 8, 0)

    def sizes(frames):
        for f in frames:
            yield pd.DataFrame({"n": [len(f)]})

    assert max(r["n"] for r in blocks.detect(b, sizes, "n long", at_a_time=3).collect()) <= 3
    assert blocks.detect(b, blocks.per_window(lambda bands: []), at_a_time=3).count() == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
