"""Commands over files: ``python -m seasight COMMAND ...``, or by spark-submit.

Pixel tables are Parquet, detections, segments and catalogue items GeoJSON.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasight.functions import geo
from seasight.functions.spectral import available_indices
from seasight.lineage import keep
from seasight.operators import catalog, coastal, detections, scene, screening
from seasight.settings import Settings
from seasight.sources import documents, reports, scenes


def _boxes(spark: SparkSession, path: str, key: str = "det_id") -> DataFrame:
    return documents.read_geojson(spark, path).withColumns({key: F.monotonically_increasing_id(), "image": F.lit(0).cast("long")})


def indices(spark: SparkSession, a: argparse.Namespace, s: Settings) -> DataFrame:
    px = spark.read.parquet(a.pixels)
    return screening.index_stats(px, available_indices(px.columns))


def screen(spark: SparkSession, a: argparse.Namespace, s: Settings) -> DataFrame:
    tiles = screening.screen(spark.read.parquet(a.pixels), a.percentile)
    if a.output:
        tiles.write.mode("overwrite").parquet(a.output)
        tiles = spark.read.parquet(a.output)
    return screening.summary(tiles)


def evaluate(spark: SparkSession, a: argparse.Namespace, s: Settings) -> DataFrame:
    scores = detections.evaluate(_boxes(spark, a.predictions), _boxes(spark, a.ground_truth, "gt_id"), a.iou)
    if a.output:
        reports.write_report(scores, a.output)
    return scores


def export(spark: SparkSession, a: argparse.Namespace, s: Settings) -> DataFrame:
    d = _boxes(spark, a.detections).filter(F.col("score") >= a.min_score)
    if a.labels:
        d = d.filter(F.col("label").isin(a.labels))
    reports.write_features(d, a.output)
    return spark.read.text(a.output).agg(F.count("*").alias("n_features"))


def beaches(spark: SparkSession, a: argparse.Namespace, s: Settings) -> DataFrame:
    """Detections and segments in degrees meet in the UTM zone of the segments' middle."""
    segments = scenes.read_segments(spark, a.segments)
    edges = scenes.edges(segments)
    span = edges.agg(F.min("lon0"), F.max("lon0"), F.min("lat0"), F.max("lat0")).first()
    if span[0] is None:
        raise ValueError(f"no segments in {a.segments}")
    if span[1] - span[0] > 6:
        print(f"segments span {span[1] - span[0]:.1f} degrees of longitude, more than a zone: those far from the middle are distorted")
    zone = int(min(max((span[0] + span[1]) / 2 + 180, 0) // 6 + 1, 60))
    at = lambda lon, lat: geo.utm_forward(F.col(lon), F.col(lat), F.lit(zone))
    (x0, y0), (x1, y1) = at("lon0", "lat0"), at("lon1", "lat1")
    e = edges.select(F.col("segment_id").alias("seg_id"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.lit(0).cast("long").alias("image"))
    e = e.join(segments.select(F.col("segment_id").alias("seg_id"), "name"), "seg_id")
    (left, low), (right, high) = at("xmin", "ymin"), at("xmax", "ymax")
    d = _boxes(spark, a.detections).select("det_id", "image", "label", left.alias("xmin"), low.alias("ymin"), right.alias("xmax"), high.alias("ymax"))
    d, e = keep(d), keep(e)  # projected once, and not inside what is made of them
    clouds = scenes.read_cloud_fractions(spark, a.clouds) if a.clouds else spark.createDataFrame([], "seg_id string, cloud_fraction double")
    labels, reach = None if a.all_labels else coastal.TARGETS, a.surf_zone or s.surf_zone
    report = coastal.rows(coastal.roll_up(d, e, clouds, labels, reach), a.day)
    if a.csv:
        report.coalesce(1).write.mode("overwrite").option("header", True).csv(a.csv)
    if a.geojson:
        crs = f"EPSG:{(32600 if span[2] + span[3] >= 0 else 32700) + zone}"
        coastal.report_geojson(report, coastal.zones(e, reach, zone), reach, a.day, crs=crs).write.mode("overwrite").text(a.geojson)
    if a.history:
        coastal.append_history(report.drop("observed_on"), a.history, a.day)
    return report


def samples(spark: SparkSession, a: argparse.Namespace, s: Settings) -> DataFrame:
    return scenes.samples(scenes.read_sidecars(spark, a.sidecars))


def detect(spark: SparkSession, a: argparse.Namespace, s: Settings) -> DataFrame:
    """A pixel table (image, r, c, bands) through the pipeline; the detector is MODULE:FUNCTION."""
    import importlib

    module, name = a.detector.split(":")
    px = spark.read.parquet(a.pixels)
    size = px.agg(F.max("c") + 1, F.max("r") + 1).first()
    found, tiles = scene.detect(px, getattr(importlib.import_module(module), name), int(size[0] or 1), int(size[1] or 1), s, not a.all_windows, scene_id=a.scene_id)
    if a.output:
        documents.write_collections(found, a.output, indices=tuple(available_indices(px.columns)))
    print(scene.summary(found, tiles))
    return found


def search(spark: SparkSession, a: argparse.Namespace, s: Settings) -> DataFrame:
    items = scenes.read_items(spark, a.items)
    most = s.max_cloud if a.max_cloud is None else a.max_cloud
    return catalog.search(items, *a.box, a.start, a.end, most, a.limit).select("scene_id", "day", "platform", "cloud")


def config(spark: SparkSession, a: argparse.Namespace, s: Settings) -> DataFrame:
    return s.table(spark)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("seasight", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(run, *names: str) -> argparse.ArgumentParser:
        c = sub.add_parser(run.__name__)
        c.set_defaults(run=run)
        for name in names:
            c.add_argument(name)
        return c

    command(indices, "pixels")
    c = command(screen, "pixels")
    c.add_argument("--percentile", type=float, default=0.999)
    c.add_argument("--output")
    c = command(evaluate, "predictions", "ground_truth")
    c.add_argument("--iou", type=float, default=0.5)
    c.add_argument("--output")
    c = command(export, "detections", "output")
    c.add_argument("--min-score", type=float, default=0.0)
    c.add_argument("--labels", nargs="*")
    c = command(beaches, "detections", "segments")
    c.add_argument("--surf-zone", type=float)
    c.add_argument("--clouds")
    c.add_argument("--csv")
    c.add_argument("--geojson")
    c.add_argument("--history")
    c.add_argument("--day", default="")
    c.add_argument("--all-labels", action="store_true")
    c = command(search, "items")
    c.add_argument("--box", type=catalog.parse_box, required=True, metavar="WEST,SOUTH,EAST,NORTH")
    c.add_argument("--start", default="0000-00-00")
    c.add_argument("--end", default="9999-99-99")
    c.add_argument("--max-cloud", type=float)
    c.add_argument("--limit", type=int, default=10)
    command(samples, "sidecars")
    c = command(detect, "pixels", "detector")
    c.add_argument("--output")
    c.add_argument("--scene-id")
    c.add_argument("--all-windows", action="store_true")
    command(config)
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("seasight").getOrCreate()
    return a.run(spark, a, Settings.load(spark))


if __name__ == "__main__":
    main().show(1000, truncate=False)
