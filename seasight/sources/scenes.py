"""Scene side-cars, split lists and coast segments from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDECAR = "scene_id string, collection string, source string, datetime string, platform string, cloud_cover double, bands array<string>, width int, height int, gsd_m double, crs string, transform array<double>, bbox_wgs84 array<double>, reflectance_scale double, reflectance_offset double"
SEGMENTS = "features array<struct<id:string,geometry:struct<type:string,coordinates:string>,properties:struct<segment_id:string,id:string,name:string,exposure:string>>>"


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """One row per side-car, with scale and offset to reckon with: 1e-4 and 0 where none is recorded."""
    d = spark.read.option("multiLine", True).schema(SIDECAR).json(path)
    return d.withColumn("path", F.col("_metadata.file_path")).withColumns({"reflectance_scale": F.coalesce("reflectance_scale", F.lit(1e-4)), "reflectance_offset": F.coalesce("reflectance_offset", F.lit(0.0))})


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """pos, roi: the names of a split list in order, without blank lines."""
    t = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.trim("value").alias("roi"))
    return t.filter("roi <> ''")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """segment_id, name, pts: the named lines of a feature collection, or the outer rings of its polygons; features without geometry go, ids fall back to properties, name, then place."""
    f = spark.read.option("multiLine", True).schema(SEGMENTS).json(path).select(F.posexplode("features").alias("pos", "f")).filter("f.geometry is not null")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    ident = F.coalesce(some("f.id"), some("f.properties.segment_id"), some("f.properties.id"), some("f.properties.name"), F.format_string("segment_%03d", "pos"))
    return f.select(ident.alias("segment_id"), F.coalesce(some("f.properties.name"), ident).alias("name"), F.transform(F.when(F.col("f.geometry.type") == "Polygon", F.get(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"), 0)).otherwise(F.from_json("f.geometry.coordinates", "array<array<double>>")), lambda p: F.struct(F.get(p, 0).alias("lon"), F.get(p, 1).alias("lat"))).alias("pts"))


def edges(segments: DataFrame) -> DataFrame:
    """segment_id, n, lon0, lat0, lon1, lat1: the edges of each line in order."""
    pairs = F.transform(F.slice("pts", F.lit(2), F.greatest(F.size("pts") - 1, F.lit(0))), lambda p, i: F.struct(F.get("pts", i).alias("a"), p.alias("b")))
    e = segments.select("segment_id", F.posexplode(pairs).alias("n", "e"))
    return e.select("segment_id", "n", F.col("e.a.lon").alias("lon0"), F.col("e.a.lat").alias("lat0"), F.col("e.b.lon").alias("lon1"), F.col("e.b.lat").alias("lat1"))


ITEMS = "features array<struct<id:string,collection:string,bbox:array<double>,properties:struct<datetime:string,platform:string,`eo:cloud_cover`:double>,assets:map<string,struct<href:string>>>>"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """scene_id, collection, day, platform, cloud, west, south, east, north, assets (name, href) of catalogue item collections."""
    f = spark.read.option("multiLine", True).schema(ITEMS).json(path).select(F.explode("features").alias("f"))
    box = [F.get("f.bbox", i).alias(n) for i, n in enumerate(("west", "south", "east", "north"))]
    return f.select(
        F.col("f.id").alias("scene_id"), "f.collection", F.substring("f.properties.datetime", 1, 10).alias("day"), "f.properties.platform", F.col("f.properties.`eo:cloud_cover`").alias("cloud"), *box,
        F.transform(F.map_entries("f.assets"), lambda a: F.struct(a["key"].alias("name"), a["value"]["href"].alias("href"))).alias("assets"),
    )


def asset_hrefs(items: DataFrame, bands: list[str] | None = None) -> DataFrame:
    """scene_id, band, href: the first asset of every canonical band, or of those of ``bands``; other assets go."""
    from seasight.operators.catalog import normalize

    a = items.select("scene_id", F.posexplode("assets").alias("pos", "a")).select("scene_id", "pos", F.col("a.name").alias("key"), "a.href")
    first = normalize(a, ["scene_id"])
    first = first if bands is None else first.filter(F.col("band").isin(list(bands)))
    return first.join(a.select("scene_id", "key", "href"), ["scene_id", "key"]).select("scene_id", "band", "href")


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """roi, bits: a JSON object of file names, each with 0 or 1 per class."""
    t = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<int>>")).alias("name", "bits"))
    return t.select(F.regexp_extract("name", r"^(?:S2_)?(.*?)(?:\.tif)?$", 1).alias("roi"), "bits")


def read_cloud_fractions(spark: SparkSession, path: str) -> DataFrame:
    """seg_id, cloud_fraction: a JSON object of segments."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,double>")).alias("seg_id", "cloud_fraction"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, size, md5 of every file; a file is read whole, so that it must fit a task (2 GB at most)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.md5("content").alias("md5"))


def samples(sidecars: DataFrame) -> DataFrame:
    """name, scene_id, date, size, cloud: the chips that side-cars describe, by name."""
    return sidecars.select(
        F.regexp_extract("path", r"([^/]+?)\.json$", 1).alias("name"), "scene_id", F.substring("datetime", 1, 10).alias("date"), F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")).alias("size"), F.col("cloud_cover").alias("cloud")
    ).orderBy("name")


def sample_boxes(sidecars: DataFrame) -> DataFrame:
    """scene_id, west, south, east, north of side-cars."""
    return sidecars.select("scene_id", *[F.get("bbox_wgs84", i).alias(n) for i, n in enumerate(("west", "south", "east", "north"))])


def sample_scenes(sidecars: DataFrame) -> DataFrame:
    """scene_id, collection, datetime, platform, cloud_cover, source: where chips are from, with the usual collection and source where a side-car is silent."""
    return sidecars.select("scene_id", F.coalesce("collection", F.lit("sentinel-2-l2a")).alias("collection"), "datetime", "platform", "cloud_cover", F.coalesce("source", F.lit("planetary-computer")).alias("source"))


def sample_reflectance(px: DataFrame, sidecars: DataFrame, bands: dict[str, str]) -> DataFrame:
    """The pixels of chips (scene_id, r, c, bands) as reflectances, by what each chip's side-car says; other layers stay."""
    from seasight.functions.spectral import scale_bands

    by = sidecars.select("scene_id", F.col("reflectance_scale").alias("_scale"), F.col("reflectance_offset").alias("_offset"))
    d = px.join(by, "scene_id", "left")
    return scale_bands(d, bands, F.coalesce("_scale", F.lit(1e-4)), F.coalesce("_offset", F.lit(0.0))).drop("_scale", "_offset")


def write_sidecars(meta: DataFrame, path: str) -> None:
    """A JSON file per scene under ``path``, in a folder of its name."""
    meta.repartition("scene_id").withColumn("name", F.col("scene_id")).write.mode("overwrite").partitionBy("name").json(path)
