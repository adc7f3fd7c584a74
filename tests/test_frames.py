import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasight.functions import geo, spectral
from seasight.operators import catalog, coastal, curves, detections, display, prompts, scene
from seasight.settings import Settings
from seasight.sources import documents, rasters, reports, scenes


def one(spark, **columns):
    """The values of column expressions, over one row."""
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def test_boxes(spark):
    box = F.array(*[F.lit(x) for x in (0.1, 0.2, 0.5, 0.6)])
    got = one(spark, **geo.box_of(box, "yxyx", F.lit(100), F.lit(10)))
    assert [round(x, 9) for x in got] == [20, 1, 60, 5]
    got = one(spark, **geo.box_of(box, "xyxy"))
    assert list(got) == [0.1, 0.2, 0.5, 0.6]
    with pytest.raises(ValueError):
        geo.box_of(box, "xxyy")
    d = spark.createDataFrame([(2.0, 3.0, 6.0, 5.0), (2.0, 3.0, 2.0, 3.0), (3.0, 0.0, 2.0, 1.0), (None, 0.0, 2.0, 1.0)], "xmin double, ymin double, xmax double, ymax double")
    x, y = geo.centre()
    rows = d.select(geo.valid_pixel_box().alias("ok"), geo.width().alias("w"), x.alias("x"), y.alias("y"), geo.xyxy().alias("all")).collect()
    assert [r["ok"] for r in rows] == [True, True, False, False] and rows[0][1:] == (4, 4, 4, [2, 3, 6, 5])


def test_tiles_and_windows(spark):
    names = ["12-34-7", "12-34-7.jpg", "/data/tiles/12-34-7.tif", "scene-abc-12-34-7.png", "C:\\x\\12-34-7.png", "12-34", "a-b-c", "200-0-7", "1-1-31", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(geo.parse_tile_name(F.col("n"))).collect()]
    assert [tuple(x) if x else None for x in got] == [(12, 34, 7)] * 5 + [None] * 5
    for w, h, size, overlap in ((512, 512, 256, 0), (1000, 700, 256, 32), (100, 100, 256, 16), (960, 960, 960, 96), (1, 1, 8, 2), (1097, 13, 128, 127)):
        rows = one(spark, w=geo.windows_of(F.lit(w), F.lit(h), size, overlap))["w"]
        seen = np.zeros((h, w), bool)
        for r in rows:
            assert 0 < r["width"] <= size and r["col_off"] + r["width"] <= w and r["row_off"] + r["height"] <= h
            seen[r["row_off"] : r["row_off"] + r["height"], r["col_off"] : r["col_off"] + r["width"]] = True
        assert seen.all() and rows == sorted(rows, key=lambda r: (r["row_off"], r["col_off"]))
    with pytest.raises(ValueError):
        geo.windows_of(F.lit(1), F.lit(1), 8, 8)
    box = lambda *v: one(spark, t=geo.tiles_of_box(*[F.lit(float(x)) for x in v], 2))["t"]
    assert [tuple(x) for x in box(-90, 0, 0, 66)] == [(1, 1)]
    assert {x["x"] for x in box(170, -10, -170, 10)} == {0, 3}
    with pytest.raises(ValueError):
        geo.tiles_of_box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), 31)


def test_stretches(spark):
    px = spark.createDataFrame([(float(i), 5.0, None, float(i)) for i in range(101)] + [(float("nan"), 5.0, None, float("inf"))], "red double, green double, blue double, nir double")
    got = display.stretch(px, ["red", "green", "blue"]).collect()
    assert [got[0]["red8"], got[50]["red8"], got[100]["red8"], got[101]["red8"]] == [0, 127, 255, 0]
    assert {r["green8"] for r in got} == {128} and {r["blue8"] for r in got} == {0}
    rgb = display.to_rgb(px, "linear").collect()
    assert [rgb[0]["r8"], rgb[100]["r8"], rgb[101]["r8"]] == [0, 255, 0] and rgb[0]["g8"] == 128 and rgb[0]["b8"] == 0
    assert display.to_rgb(px, "none", gamma=2.0, most=100.0).collect()[50]["r8"] == 64
    for bad in ({"how": "x"}, {"gamma": 0}, {"low": 5, "high": 5}):
        with pytest.raises(ValueError):
            display.to_rgb(px, **bad)
    with pytest.raises(KeyError):
        display.to_rgb(px.drop("blue"))


def test_crops_grow_and_stay_inside(spark):
    rows = [("a", 50, 60, 1), ("a", 52, 64, 1), ("a", 0, 0, 0), ("b", 1, 1, 0), ("c", 0, 199, 1)]
    d = spark.createDataFrame(rows, "k string, r long, c long, code long")
    got = {r["k"]: tuple(r)[1:] for r in display.crops(d, ["k"], F.col("code") == 1, 200, 100, 4, 20).collect()}
    assert got == {"a": (52, 72, 41, 61), "b": (0, 200, 0, 100), "c": (189, 200, 0, 10)}


def test_scaling(spark):
    d = spark.createDataFrame([(2000, 6, 7)], "nir long, scl long, other long")
    got = spectral.scale_bands(d, {"nir": "B08", "scl": "SCL"}).first()
    assert got["nir"] == pytest.approx(0.1) and (got["scl"], got["other"]) == (6, 7)
    asset = "array(named_struct('band', {}, 'scale', {}, 'offset', {}))"
    params = lambda a, b: tuple(one(spark, p=spectral.item_params(F.expr(a), F.lit(b).cast("string")))["p"])
    assert params(asset.format("'B04'", "0.001", "cast(null as double)"), "05.10") == (0.001, 0.0)
    assert params(asset.format("'AOT'", "0.001", "0.5"), "03.01") == (1e-4, 0.0)
    assert params(asset.format("'B04'", "cast(null as double)", "0.5"), None) == (1e-4, -0.1)


def test_prompt_sets(spark):
    p = prompts.prompt_set("minimal")
    got = one(spark, a=p.label_for_index(F.lit(3)), b=p.label_for_index(F.lit(99)), c=p.label_for_index(F.lit(-1)), d=p.label_for_text(F.lit("Floating plastic")))
    assert tuple(got) == ("ship", "unknown", "unknown", "marine_debris")
    assert {c for _, c in p.targets_only().entries} == {"marine_debris"} and p.caption().startswith("floating plastic debris. marine") and p.caption().endswith("water.")
    assert p.with_prompts({"a ship": "cloud", "a buoy": "ship"}).entries[-1] == ("a buoy", "ship") and len(p.with_prompts({"a ship": "cloud"}).entries) == len(p.entries)
    for bad in ((), (("x", "ship"),), (("x", "marine_debris"), ("x", "ship"))):
        with pytest.raises(ValueError):
            prompts.PromptSet(bad)
    with pytest.raises(KeyError):
        prompts.prompt_set("none")


def test_catalogue_names(spark):
    got = one(spark, code=catalog.class_code(F.lit("Foam")), site=catalog.site(catalog.roi_tile(F.lit("1-12-19_48MYU_0"))), other=catalog.site(F.lit("X")), url=catalog.tile_url_template("http://t/", F.lit("a"), F.lit("b")))
    assert tuple(got) == (9, "Jakarta, Indonesia", "X", "http://t/a/b/{z}/{x}/{y}.png")
    with pytest.raises(Exception, match="no annotated class"):
        one(spark, code=catalog.class_code(F.lit("Pool")))
    assert catalog.parse_box("1, 2 3,4") == (1, 2, 3, 4)
    for bad in ("1,2,3", "a,b,c,d", ""):
        with pytest.raises(ValueError):
            catalog.parse_box(bad)


def test_collections_are_read_back(spark, tmp_path):
    rows = [(1, 0, "ship", 0.1234567, 1.0, 2.0, 3.0, 5.0, 10.0, "s0", 0.5), (2, 0, "sargassum", 0.5, 0.0, 0.0, 1.0, 1.0, 10.0, "s0", None), (3, 1, "ship", 1.0, 0.0, 0.0, 1.0, 1.0, None, "s1", 0.25)]
    d = spark.createDataFrame(rows, "det_id long, image long, label string, score double, xmin double, ymin double, xmax double, ymax double, gsd_m double, scene_id string, fdi double")
    whole = {r["image"]: json.loads(r["value"]) for r in documents.collections(d, indices=("fdi",)).collect()}
    first = whole[0]
    assert first["type"] == "FeatureCollection" and first["crs"]["properties"]["name"].endswith("CRS84") and first["properties"] == {"count": 2, "scene_id": "s0"}
    assert first["features"][0]["properties"] == {"label": "ship", "score": 0.123457, "scene_id": "s0", "fdi": 0.5, "gsd_m": 10.0, "area_m2": 600.0}
    documents.write_collections(d, f"file://{tmp_path}/out")
    back = {(r["label"], r["xmax"], r["scene_id"], r["area_m2"]) for r in documents.read_properties(spark, f"file://{tmp_path}/out").collect()}
    assert back == {("ship", 3.0, "s0", 600.0), ("sargassum", 1.0, "s0", 100.0), ("ship", 1.0, "s1", None)}
    assert documents.output_path("/a/", "x") == "/a/x.geojson" and documents.output_path("/a", "x.geojson") == "/a/x.geojson"


def test_rasters(spark, tmp_path):
    planes = {"B03": np.arange(2400).reshape(40, 60) % 700, "B08": np.full((40, 60), 9)}
    (tmp_path / "a.tif").write_bytes(rasters.encode(planes, (10.0, 0.0, 5e5, 0.0, -10.0, 4e6), 32633))
    p = rasters.profiles(spark, f"file://{tmp_path}/a.tif").first()
    assert (p["width"], p["height"], p["bands"], p["epsg"], p["gsd"], p["names"]) == (60, 40, 2, 32633, 10.0, ["B03", "B08"]) and p["transform"] == [10.0, 0.0, 5e5, 0.0, -10.0, 4e6]
    px = rasters.pixels(rasters.read_rows(spark, f"file://{tmp_path}/a.tif"))
    assert px.count() == 2400 and {(r["r"], r["c"], r["B03"], r["B08"]) for r in rasters.window(px, 5, 7, 2, 1).collect()} == {(0, 0, float((7 * 60 + 5) % 700), 9.0), (0, 1, float((7 * 60 + 6) % 700), 9.0)}
    back = rasters.chips(px.withColumn("k", F.lit(1)), "k", ["B03", "B08"], 60, 40).first()["content"]
    assert (rasters.Tiff(bytes(back)).array()[0] == planes["B03"]).all()
    with pytest.raises(ValueError):
        rasters.Tiff(b"no")


def test_deflated_tiles_with_predictor():
    import struct
    import zlib

    data = (np.arange(32 * 48).reshape(32, 48) * 7 % 251).astype("<u2")
    tiles = [data[y : y + 16, x : x + 16] for y in (0, 16) for x in (0, 16, 32)]
    raw = [zlib.compress(np.diff(t.astype(int), axis=1, prepend=0).astype("<u2").tobytes()) for t in tiles]
    body, starts = b"", []
    for x in raw:
        starts.append(8 + len(body))
        body += x + b"\0" * (len(x) % 2)
    at = 8 + len(body)
    tags = [(256, 4, [48]), (257, 4, [32]), (258, 3, [16]), (259, 3, [8]), (317, 3, [2]), (322, 4, [16]), (323, 4, [16]), (324, 4, starts), (325, 4, [len(x) for x in raw])]
    head, extra, where = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, kind, v in tags:
        packed = struct.pack("<" + {3: "H", 4: "I"}[kind] * len(v), *v)
        head += struct.pack("<HHI", tag, kind, len(v)) + (packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack("<I", where + len(extra)))
        extra += packed if len(packed) > 4 else b""
    t = rasters.Tiff(struct.pack("<2sHI", b"II", 42, at) + body + struct.pack("<H", len(tags)) + head + struct.pack("<I", 0) + extra)
    assert (t.array()[0] == data).all()


def test_grids(spark):
    """80 m blocks on grids of 10, 20 and 60 m: refined grids are those of the blocks, away from their edges."""
    block = lambda r, c, size: float((int(r * size // 80) + int(c * size // 80)) % 2 * 1000)
    coarse = spark.createDataFrame([(r, c, block(r, c, 20)) for r in range(16) for c in range(16)], "r long, c long, v double")
    near = {(x["r"], x["c"]): x["v"] for x in rasters.on_grid(coarse, 10, 20, "nearest").collect()}
    assert near == {(r, c): block(r, c, 10) for r in range(32) for c in range(32)}
    fine = {(x["r"], x["c"]): x["v"] for x in rasters.on_grid(coarse, 10, 20).collect()}
    assert len(fine) == 1024 and all(fine[r, c] == block(r, c, 10) for r in range(32) for c in range(32) if r % 8 not in (0, 7) and c % 8 not in (0, 7)) and fine[7, 2] == 250.0
    third = rasters.on_grid(coarse, 60, 20).collect()
    assert len(third) == 36


def test_scene_path(spark):
    """A planted patch gets its window screened in, and only that window detected, with its place on the map and its evidence."""

    def corner(parts):
        for t in parts:
            yield t[["image", "row_off", "col_off"]].assign(xmin=0.0, ymin=0.0, xmax=4.0, ymax=4.0, label="marine_debris", score=0.8)

    water = {"green": 0.025, "red": 0.015, "rededge2": 0.005, "nir": 0.003, "swir1": 0.001}
    rows = []
    for r in range(128):
        for c in range(128):
            v = dict(water, nir=0.003 + (r * 31 + c * 17) % 10 * 1e-5)
            if 80 <= r < 86 and 90 <= c < 96:
                v = dict(v, green=0.035, red=0.018, rededge2=0.012, nir=0.030, swir1=0.004)
            rows.append((0, r, c, *v.values(), 6))
    px = spark.createDataFrame(rows, "image long, r long, c long, green double, red double, rededge2 double, nir double, swir1 double, scl long")
    s = Settings(tile_size=64, tile_overlap=0)
    found, tiles = scene.detect(px, corner, 128, 128, s, percentile=0.9, transform=(10.0, 0.0, 5e5, 0.0, -10.0, 4e6), zone=33, scene_id="x")
    got = found.collect()
    assert [(r["xmin"], r["ymin"], r["scene_id"]) for r in got] == [(64.0, 64.0, "x")] and got[0]["fdi"] is not None
    assert got[0]["ring"][0]["x"] == pytest.approx(15.0071, abs=1e-3) and got[0]["ring"][0]["y"] == pytest.approx(36.139, abs=1e-2)
    assert scene.summary(found, tiles).startswith("1 detections | 1/4 windows")


def test_raw_boxes(spark):
    raw = spark.createDataFrame([([0.0, 0.0, 1.5, 0.5], 1.2, 1), ([0.5, 0.9, 0.1, 0.2], 0.9, 1), ([0.0, 0.0, 0.1, 0.1], 0.1, 9)], "box array<double>, score double, class int")
    got = [tuple(r) for r in scene.to_detections(raw, 100, 10, {1: "ship"}, least=0.2).select("xmin", "ymin", "xmax", "ymax", "label", "score").collect()]
    assert got == [(0.0, 0.0, 50.0, 10.0, "ship", 1.0)]


SEGS = "seg_id long, name string, image long, x0 double, y0 double, x1 double, y1 double"
BOXES = "det_id long, image long, label string, xmin double, ymin double, xmax double, ymax double, score double"


def test_coast_report(spark):
    segs = spark.createDataFrame([(1, "a", 0, 0.0, 0.0, 100.0, 0.0), (1, "a", 0, 100.0, 0.0, 100.0, 50.0), (2, "b", 0, 500.0, 0.0, 600.0, 0.0), (3, None, 0, 900.0, 0.0, 950.0, 0.0)], SEGS)
    # two boxes that overlap, one of which only touches the zone, a ship, and one far away
    d = spark.createDataFrame([(1, 0, "sargassum", 40.0, 5.0, 60.0, 15.0, 0.5), (2, 0, "marine_debris", 50.0, 10.0, 70.0, 60.0, 0.5), (3, 0, "ship", 40.0, 5.0, 60.0, 15.0, 0.5), (4, 0, "sargassum", 700.0, 0.0, 710.0, 9.0, 0.5)], BOXES)
    clouds = spark.createDataFrame([(2, 0.71), (3, 0.3)], "seg_id long, cloud_fraction double")
    got = {r["seg_id"]: r for r in coastal.roll_up(d, segs, clouds).collect()}
    r = got[1]
    assert r["n_detections"] == 2 and r["area"] == 20 * 10 + 20 * 10 - 10 * 5 and r["front_length"] == 150
    assert r["front"] == pytest.approx(68, abs=3) and r["coverage"] == pytest.approx(350 / r_zone(segs), rel=1e-9)
    assert [x["seg_id"] for x in coastal.ranked(coastal.roll_up(d, segs, clouds)).collect()] == [1, 3, 2]
    assert (got[2]["state"], got[3]["state"], got[3]["front_fraction"]) == ("blind", "partial", 0.0)
    for bad in ({"reach": 0}, {"partial_above": 0.9}, {"blind_above": 1.5}):
        with pytest.raises(ValueError):
            coastal.roll_up(d, segs, clouds, **bad)
    with pytest.raises(ValueError):
        coastal.roll_up(d, segs.limit(0), clouds)
    with pytest.raises(Exception, match="from 0 to 1"):
        coastal.roll_up(d, segs, clouds.withColumn("cloud_fraction", F.lit(1.2))).collect()


def r_zone(segs):
    return {r["seg_id"]: r["zone_area"] for r in coastal.zone_area(segs).collect()}[1]


def test_zone_of_a_line(spark):
    segs = spark.createDataFrame([(1, "a", 0, 0.0, 0.0, 100.0, 0.0)], SEGS)
    assert r_zone(segs) == pytest.approx(100 * 40 + np.pi * 400, rel=0.01)
    shape = json.loads(coastal.zones(segs, 20.0).first()["geometry"])
    ring = np.array(shape["coordinates"][0][0])
    area = abs(np.sum(ring[:-1, 0] * ring[1:, 1] - ring[1:, 0] * ring[:-1, 1])) / 2
    assert shape["type"] == "MultiPolygon" and area == pytest.approx(100 * 40 + np.pi * 400, rel=0.01)


def test_report_collection(spark):
    segs = spark.createDataFrame([(1, 'a "b"', 0, 0.0, 0.0, 100.0, 0.0), (2, None, 0, 500.0, 0.0, 600.0, 0.0)], SEGS)
    d = spark.createDataFrame([(1, 0, "sargassum", 40.0, 5.0, 60.0, 15.0, 0.5)], BOXES)
    clouds = spark.createDataFrame([(2, 0.9)], "seg_id long, cloud_fraction double")
    flat = coastal.rows(coastal.roll_up(d, segs, clouds), "2024-01-01", "s")
    g = json.loads(coastal.report_geojson(flat, coastal.zones(segs, 20.0), 20.0, "2024-01-01", "s", "EPSG:32616").first()["value"])
    assert [f["id"] for f in g["features"]] == ["1", "2"] and g["features"][0]["properties"]["name"] == 'a "b"' and g["features"][1]["properties"]["name"] == "2"
    assert g["properties"]["count"] == 2 and g["properties"]["blind_segments"] == 1 and g["properties"]["affected_segments"] == 1 and g["properties"]["metric_crs"] == "EPSG:32616"


def test_cloud_of_zones(spark):
    segs = spark.createDataFrame([(1, "a", 0, 0.0, 0.0, 100.0, 0.0), (2, "b", 0, 9000.0, 0.0, 9100.0, 0.0)], SEGS)
    px = spark.range(400).select((F.col("id") / 20).cast("long").alias("r"), (F.col("id") % 20).alias("c"), F.when(F.col("id") < 200, 9).otherwise(6).alias("scl"))
    got = {r["seg_id"]: r["cloud_fraction"] for r in coastal.cloud_fractions(px, segs, (10.0, 0.0, -50.0, 0.0, -10.0, 100.0)).collect()}
    assert got[2] == 1.0 and got[1] == pytest.approx(0.5, abs=0.1)
    with pytest.raises(ValueError):
        coastal.cloud_fractions(px, segs, (10.0, 1.0, 0.0, 0.0, -10.0, 0.0))


def test_reports(spark):
    counts = spark.createDataFrame([("Marine Debris", "Marine Debris", 8), ("Marine Debris", "Ship", 2), ("Ship", "Ship", 1500)], "truth string, pred string, n long")
    o = curves.overall(counts).first()
    assert o["n"] == 1510 and o["accuracy"] == pytest.approx(1508 / 1510) and o["macro_f1"] == pytest.approx((16 / 18 + 3000 / 3002) / 2)
    lines = [r["line"] for r in reports.training_markdown(counts, 12345, [("NDVI", 0.25)]).collect()]
    assert lines[0] == "Trained on 12,345 pixels, tested on 1,510 held-out pixels." and "- macro F1 across 2 classes: **0.944**" in lines
    assert lines.index("| Ship | 0.999 | 1.000 | 0.999 | 1,500 |") < lines.index("| Marine Debris | 1.000 | 0.800 | 0.889 | 10 |") and lines[-1] == "- `NDVI` 0.2500"
    box = lambda i, label: (i, 0, label, 0.0 + 20 * i, 0.0, 10.0 + 20 * i, 10.0, 0.9)
    d, g = spark.createDataFrame([box(0, "a"), box(1, "b"), box(5, "b")], BOXES), spark.createDataFrame([box(0, "a"), box(1, "a")], BOXES.replace("det_id", "gt_id"))
    m = detections.match(d, g, 0.5, False)
    lines = [r["line"] for r in reports.evaluation_markdown(detections.evaluate(d, g), detections.confusion(d, g, m), ["a", "b"], scene_id="s").collect()]
    assert "| **True a** | 1 | 1 | 0 |" in lines and "| **True none** | 0 | 1 | 0 |" in lines and "| 1 | 2 | 1 |" in lines and lines[2] == "Scene: `s`"


def test_flags_and_sweep(spark):
    d = spark.createDataFrame([(1, 0, "a", 0.0, 0.0, 10.0, 10.0, 0.9), (2, 0, "a", 50.0, 0.0, 60.0, 10.0, 0.8)], BOXES)
    g = spark.createDataFrame([(1, 0, "a", 0.0, 0.0, 10.0, 8.0, 1.0)], BOXES.replace("det_id", "gt_id"))
    m = detections.match(d, g)
    assert {(r["det_id"], r["hit"]) for r in detections.hit_flags(d, m).collect()} == {(1, True), (2, False)}
    assert {r["threshold"]: r["ap"] for r in detections.sweep(d, g).collect()} == {t: 1.0 if t <= 0.8 else 0.0 for t in detections.THRESHOLDS}


def test_best_threshold(spark):
    x = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.8), (3, 1, 0.7), (4, 0, 0.1)], "id long, pos long, score double")
    r = curves.best_threshold(x).first()
    assert (r["threshold"], r["recall"]) == (0.7, 1.0) and r["precision"] == pytest.approx(2 / 3) and r["f1"] == pytest.approx(0.8)
    got = [r["score"] for r in curves.permuted(x, "score", "id", 1).collect()]
    assert sorted(got) == [0.1, 0.7, 0.8, 0.9]


def test_sample_files(spark, tmp_path):
    (tmp_path / "accra.json").write_text('{"scene_id": "S2", "datetime": "2024-05-27T10:00:00Z", "width": 512, "height": 512, "bbox_wgs84": [1, 2, 3, 4], "reflectance_scale": 0.0001, "reflectance_offset": -0.1}')
    s = scenes.read_sidecars(spark, f"file://{tmp_path}/*.json")
    assert tuple(scenes.samples(s).first()) == ("accra", "S2", "2024-05-27", "512x512", None)
    assert tuple(scenes.sample_boxes(s).first()) == ("S2", 1, 2, 3, 4) and scenes.sample_scenes(s).first()["collection"] == "sentinel-2-l2a"
    px = spark.createDataFrame([("S2", 0, 0, 2000, 6)], "scene_id string, r long, c long, nir long, scl long")
    assert scenes.sample_reflectance(px, s, {"nir": "B08", "scl": "SCL"}).first()["nir"] == pytest.approx(0.1)
