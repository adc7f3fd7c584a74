import json

import pytest

from seasight.__main__ import main
from seasight.operators import patches
from seasight.settings import Settings
from seasight.sources.scenes import checksums, read_label_map


def test_split_patches(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"S2_1-12-19_48MYU_0.tif": [1, 0, 1], "S2_b.tif": [0, 1]}))
    labels = read_label_map(spark, f"file://{tmp_path}/l.json")
    ids = spark.createDataFrame([("1-12-19_48MYU_0",), ("b",), ("c",)], "roi string")
    got = {r["roi"]: (r["labels"], r["debris"]) for r in patches.split_patches(ids, labels).collect()}
    assert got == {"1-12-19_48MYU_0": (["Marine Debris", "Sparse Sargassum"], True), "b": (["Dense Sargassum"], False), "c": ([], False)}
    assert patches.split_patches(ids, labels, True).count() == 1
    assert checksums(spark, f"file://{tmp_path}/l.json").first()["size"] == (tmp_path / "l.json").stat().st_size


def test_settings(spark):
    assert Settings.load(spark, {"SEASIGHT_TILE_SIZE": "512"}) == Settings(tile_size=512)
    with pytest.raises(ValueError):
        Settings(tile_size=96, tile_overlap=96)
    with pytest.raises(ValueError):
        Settings(nms_iou=1.5)


def _square(lon, lat, label, half=0.0005):
    ring = [[lon - half, lat - half], [lon + half, lat - half], [lon + half, lat + half], [lon - half, lat + half], [lon - half, lat - half]]
    return {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"label": label, "score": 0.9}}


def test_commands(spark, tmp_path):
    """A detection near the corner of a segment of two edges counts once; one far away not at all."""
    at = lambda name: f"file://{tmp_path}/{name}"
    (tmp_path / "d.json").write_text(json.dumps({"features": [_square(-86.75, 21.10, "sargassum"), _square(-86.75, 21.2, "sargassum"), _square(-86.75, 21.1, "ship")]}))
    line = {"type": "LineString", "coordinates": [[-86.75, 21.09], [-86.75, 21.10], [-86.75, 21.11]]}
    (tmp_path / "s.json").write_text(json.dumps({"features": [{"id": "north", "geometry": line, "properties": {"name": "North"}}]}))
    (tmp_path / "c.json").write_text('{"north": 0.5}')
    r = main(["beaches", at("d.json"), at("s.json"), "--clouds", at("c.json"), "--csv", at("csv")], spark).collect()
    assert [(x["seg_id"], x["n_detections"], x["state"]) for x in r] == [("north", 1, "partial")] and r[0]["area"] == pytest.approx(111 * 104, rel=0.02)
    assert spark.read.option("header", True).csv(at("csv")).count() == 1
    assert main(["beaches", at("d.json"), at("s.json"), "--all-labels"], spark).first()["n_detections"] == 2
    assert main(["export", at("d.json"), at("out"), "--labels", "ship"], spark).first()["n_features"] == 1
    got = {x["label"]: x["tp"] for x in main(["evaluate", at("d.json"), at("d.json")], spark).collect()}
    assert got == {"sargassum": 2, "ship": 1, "all": 3}
    assert main(["config"], spark).filter("name = 'tile_size'").first()["value"] == "960"
