"""GeoJSON documents in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = "features array<struct<geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:struct<label:string,score:double>>>"
#: What a file may say of a feature beyond label and score.
PROPERTIES = "label string, score double, model string, tile string, scene_id string, collection string, datetime string, gsd_m double, area_m2 double"
CRS84 = '{"type":"name","properties":{"name":"urn:ogc:def:crs:OGC:1.3:CRS84"}}'


def feature(df: DataFrame, indices: tuple[str, ...] = ()) -> Column:
    """A detection as a GeoJSON feature: its ring (or its box, as a closed ring) and what its columns say.

    Scores and the named ``indices`` have 6 digits, half to even; area_m2, if
    gsd_m is known, 2. model, tile, scene_id, collection and datetime are taken
    over where the columns are there and not NULL.
    """
    x = lambda a, b: F.array(F.col(a), F.col(b))
    if "ring" in df.columns:
        points = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
        ring = F.concat(points, F.slice(points, 1, 1))
    else:
        ring = F.array(x("xmin", "ymin"), x("xmax", "ymin"), x("xmax", "ymax"), x("xmin", "ymax"), x("xmin", "ymin"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    own = [c for c in ("model", "tile", "scene_id", "collection", "datetime") if c in df.columns]
    more = [F.bround(F.col(c).cast("double"), 6).alias(c) for c in indices]
    if "gsd_m" in df.columns:
        area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")) * F.col("gsd_m") * F.col("gsd_m")
        more += [F.bround(F.col("gsd_m").cast("double"), 6).alias("gsd_m"), F.bround(area, 2).alias("area_m2")]
    properties = F.struct("label", F.bround("score", 6).alias("score"), *own, *more)
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def features(dets: DataFrame, indices: tuple[str, ...] = ()) -> DataFrame:
    """det_id, feature: every detection as a GeoJSON ``feature``."""
    return dets.select("det_id", feature(dets, indices).alias("feature"))


def collections(dets: DataFrame, keys: tuple[str, ...] = ("image",), indices: tuple[str, ...] = (), meta: tuple[str, ...] = ()) -> DataFrame:
    """keys, value: a FeatureCollection per scene, with its crs and count and the ``meta`` columns' first values; features by det_id. A scene's detections are one document."""
    scene = F.first("scene_id", True) if "scene_id" in dets.columns else F.lit(None).cast("string")
    one = dets.withColumn("_f", feature(dets, indices)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("det_id", "_f"))).alias("_f"), scene.alias("scene_id"), *[F.first(m, True).alias(f"_{m}") for m in meta])
    properties = F.to_json(F.struct(F.size("_f").alias("count"), F.col("scene_id"), *[F.col(f"_{m}").alias(m) for m in meta]), {"ignoreNullFields": "false"})
    text = F.concat(F.lit(f'{{"type":"FeatureCollection","crs":{CRS84},"features":['), F.array_join(F.transform("_f", lambda x: x["_f"]), ","), F.lit('],"properties":'), properties, F.lit("}"))
    return one.select(*keys, text.alias("value"))


def write_collections(dets: DataFrame, path: str, keys: tuple[str, ...] = ("image",), **how) -> None:
    """A file per scene under ``path``, in a folder named by the keys; ``read_geojson`` reads them back."""
    made = collections(dets, keys, **how)
    made.repartition(*keys).write.mode("overwrite").partitionBy(*keys).text(path)


def output_path(folder: str, name: str) -> str:
    """Where a scene's document goes."""
    return f"{folder.rstrip('/')}/{name if name.endswith('.geojson') else name + '.geojson'}"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """label, score and the box of every feature of the collections at ``path``; label unknown and score 1 by default."""
    return from_features(_features(spark, path, FEATURES))


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """``read_geojson`` with all PROPERTIES; NULL where a feature lacks one."""
    inner = ",".join(f"{x.split()[0]}:{x.split()[1]}" for x in PROPERTIES.split(", "))
    f = _features(spark, path, FEATURES.replace("properties:struct<label:string,score:double>", f"properties:struct<{inner}>"))
    return from_features(f, tuple(x.split()[0] for x in PROPERTIES.split(", ")[2:]))


def _features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema(schema).json(path).select(F.explode("features").alias("f"))


def from_features(f: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    points = F.flatten("f.geometry.coordinates")
    axis = lambda i: F.transform(points, lambda p: F.get(p, i))
    return f.select(
        F.coalesce("f.properties.label", F.lit("unknown")).alias("label"), F.coalesce("f.properties.score", F.lit(1.0)).alias("score"),
        F.array_min(axis(0)).alias("xmin"), F.array_min(axis(1)).alias("ymin"), F.array_max(axis(0)).alias("xmax"), F.array_max(axis(1)).alias("ymax"),
        *[F.col(f"f.properties.{c}").alias(c) for c in more],
    )
