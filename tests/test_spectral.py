import math

import pytest

from seasight.functions import geo, spectral
from pyspark.sql import functions as F


def one(spark, **bands):
    row = ", ".join(f"CAST({'NULL' if v is None else v} AS DOUBLE) AS {k}" for k, v in bands.items())
    return spectral.compute_indices(spark.sql(f"SELECT {row}")).first()


def test_goldens(spark):
    assert one(spark, nir=0.6, red=0.2)["ndvi"] == pytest.approx(0.5)
    assert one(spark, nir=0.6, red=0.2)["pi"] == pytest.approx(0.75)
    assert one(spark, green=0.3, nir=0.1)["ndwi"] == pytest.approx(0.5)
    assert one(spark, green=0.30, swir1=0.05)["mndwi"] == pytest.approx(0.25 / 0.35)
    assert one(spark, nir=0.40, swir1=0.10)["ndmi"] == pytest.approx(0.6)


def test_no_data_and_vanishing_denominators_give_null(spark):
    for bands in ({"nir": None, "red": 0.1}, {"nir": 0.0, "red": 0.0}, {"nir": 0.2, "red": -0.2}):
        assert one(spark, **bands)["ndvi"] is None


def test_slopes():
    assert spectral.slope(scale=10) == pytest.approx(1.7777777777777777)
    assert spectral.slope() == pytest.approx(168 / 945)
    assert spectral.slope(spectral.NIR_WIDE, 10) == pytest.approx(1.8730, abs=1e-4)


def test_unknown_index_raises_and_missing_band_skips(spark):
    df = spark.sql("SELECT 0.1D AS nir, 0.2D AS red")
    assert "ndwi" not in spectral.compute_indices(df, ["ndwi", "ndvi"]).columns
    with pytest.raises(KeyError):
        spectral.compute_indices(df, ["nope"])


def test_masks_with_nulls(spark):
    df = spark.sql("SELECT * FROM VALUES (CAST(NULL AS DOUBLE)), (9D), (6D), (8.4D) AS t(scl)")
    assert [r[0] for r in df.select(spectral.cloud_mask()).collect()] == [True, True, False, True]


def test_baselines(spark):
    df = spark.sql("SELECT * FROM VALUES ('05.10'), ('04.00'), ('03.01'), (NULL), ('x') AS t(b)")
    assert [r[0] for r in df.select(spectral.baseline_offset(F.col("b"))).collect()] == [-0.1, -0.1, 0.0, -0.1, -0.1]


def test_utm_golden(spark):
    df = spark.sql("SELECT 15.0D AS lon, 36.14471809881776D AS lat")
    e, n = df.select(*geo.utm_forward(F.col("lon"), F.col("lat"), F.lit(33))).first()
    assert e == pytest.approx(500000, abs=1e-3) and n == pytest.approx(4000000, abs=1e-2)


def test_world_tile(spark):
    df = spark.sql("SELECT 0 AS y, 0 AS z")
    assert df.select(geo.tile_lat(F.col("y"), F.col("z"))).first()[0] == pytest.approx(85.0511287798066)
    assert df.select(geo.lat_tile(F.lit(89.9), F.lit(3)), geo.lon_tile(F.lit(180.0), F.lit(3))).first()[:] == (0, 7)
    assert math.isclose(df.select(geo.tile_lon(F.lit(1), F.lit(1))).first()[0], 0.0)
