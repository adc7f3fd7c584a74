"""Views of the test tables in the engine's own terms: pixels, detections, ground truth, coast segments, spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

#: One row per pixel of a scene 100 columns wide; tiles of 25 x 25; every 97th pixel has no data.
PX = """SELECT event_id AS pid, CAST(floor(event_id / 100.0e0) AS bigint) AS r, event_id % 100 AS c,
  CAST(floor(event_id / 2500.0e0) AS bigint) AS tr, CAST(floor((event_id % 100) / 25.0e0) AS bigint) AS tc,
  CAST(0.020e0 + (user_id % 7) * 0.002e0 AS double) AS green, CAST(0.010e0 + (event_id % 5) * 0.001e0 AS double) AS red,
  CAST(0.004e0 + (event_id % 11) * 0.001e0 AS double) AS rededge2,
  CAST(CASE WHEN event_id % 97 = 0 THEN NULL ELSE 0.002e0 + value / 10000.0e0 END AS double) AS nir,
  CAST(0.001e0 + (user_id % 3) * 0.001e0 AS double) AS swir1,
  CASE WHEN event_type = 'error' THEN 9 WHEN event_type = 'signup' AND user_id % 10 = 0 THEN 3 ELSE 6 END AS scl FROM events"""

DETS = """SELECT event_id AS det_id, CAST(floor(event_id / 1000.0e0) AS bigint) AS image,
  CASE WHEN event_id % 3 = 0 THEN 'marine_debris' WHEN event_id % 3 = 1 THEN 'sargassum' ELSE 'ship' END AS label,
  CAST((event_id % 100) * 10 + user_id % 5 AS double) AS xmin, CAST(floor((event_id % 1000) / 100.0e0) * 10 + user_id % 3 AS double) AS ymin,
  CAST((event_id % 100) * 10 + user_id % 5 + 8 AS double) AS xmax, CAST(floor((event_id % 1000) / 100.0e0) * 10 + user_id % 3 + 8 AS double) AS ymax,
  CAST(value / 500.0e0 AS double) AS score FROM events"""

GTS = """SELECT o_orderkey AS gt_id, CAST(floor(o_orderkey / 1000.0e0) AS bigint) AS image,
  CASE WHEN o_orderkey % 3 = 0 THEN 'marine_debris' WHEN o_orderkey % 3 = 1 THEN 'sargassum' ELSE 'ship' END AS label,
  CAST((o_orderkey % 100) * 10 AS double) AS xmin, CAST(floor((o_orderkey % 1000) / 100.0e0) * 10 AS double) AS ymin,
  CAST((o_orderkey % 100) * 10 + 8 AS double) AS xmax, CAST(floor((o_orderkey % 1000) / 100.0e0) * 10 + 8 AS double) AS ymax
  FROM orders WHERE o_custkey % 4 <> 0"""

SEGS = """SELECT n_nationkey AS seg_id, n_name AS name, CAST(n_nationkey % 5 AS bigint) AS image, CAST(n_nationkey * 40 AS double) AS x0, CAST(0 AS double) AS y0,
  CAST(n_nationkey * 40 + 30 AS double) AS x1, CAST(10 * (n_regionkey + 1) AS double) AS y1 FROM nation"""

CLOUDS = "SELECT n_nationkey AS seg_id, CAST((n_nationkey % 11) / 10.0e0 AS double) AS cloud_fraction FROM nation WHERE n_nationkey % 7 <> 6"

#: Boxes of many sizes and all classes that overlap each other, with scores that tie.
MARKS = """SELECT event_id AS det_id, CAST(floor(event_id / 1000.0e0) AS bigint) AS image,
  CASE event_id % 9 WHEN 0 THEN 'marine_debris' WHEN 1 THEN 'sargassum' WHEN 2 THEN 'ship' WHEN 3 THEN 'ship_wake' WHEN 4 THEN 'sea_foam' WHEN 5 THEN 'cloud' WHEN 6 THEN 'sediment_plume' WHEN 7 THEN 'open_water' ELSE 'unknown' END AS label,
  CAST((event_id % 100) * 10 + user_id % 5 AS double) AS xmin, CAST(floor((event_id % 1000) / 100.0e0) * 4 + user_id % 3 AS double) AS ymin,
  CAST((event_id % 100) * 10 + user_id % 5 + 4 + user_id % 11 AS double) AS xmax, CAST(floor((event_id % 1000) / 100.0e0) * 4 + user_id % 3 + 3 + event_id % 8 AS double) AS ymax,
  CAST(floor(value / 5.0e0) / 100.0e0 AS double) AS score FROM events"""

#: The same off whole coordinates, from under a metre to six kilometres long.
DRIFT = """SELECT event_id AS det_id, CAST(floor(event_id / 1000.0e0) AS bigint) AS image,
  CASE event_id % 9 WHEN 0 THEN 'marine_debris' WHEN 1 THEN 'sargassum' WHEN 2 THEN 'ship' WHEN 3 THEN 'ship_wake' WHEN 4 THEN 'sea_foam' WHEN 5 THEN 'cloud' WHEN 6 THEN 'sediment_plume' WHEN 7 THEN 'open_water' ELSE 'unknown' END AS label,
  CAST((event_id % 100) * 10 + user_id % 5 + 0.3e0 AS double) AS xmin, CAST(floor((event_id % 1000) / 100.0e0) * 4 + (user_id % 7) / 8.0e0 AS double) AS ymin,
  CAST((event_id % 100) * 10 + user_id % 5 + CASE WHEN event_id % 400 = 0 THEN 6000 ELSE 0.7e0 + user_id % 11 END AS double) AS xmax,
  CAST(floor((event_id % 1000) / 100.0e0) * 4 + (user_id % 7) / 8.0e0 + 0.4e0 + event_id % 8 AS double) AS ymax,
  CAST(floor(value / 5.0e0) / 100.0e0 AS double) AS score FROM events"""

#: Coast segments of one to many edges each.
SHORE = """SELECT CAST(s_nationkey AS bigint) AS seg_id, 'coast ' || s_nationkey AS name, CAST(s_nationkey % 5 AS bigint) AS image,
  CAST(s_nationkey * 40 + (s_suppkey % 4) * 8 AS double) AS x0, CAST((s_suppkey % 3) * 6 AS double) AS y0,
  CAST(s_nationkey * 40 + (s_suppkey % 4) * 8 + 8 AS double) AS x1, CAST((s_suppkey % 5) * 5 AS double) AS y1 FROM supplier"""

VIEWS = {"marks": MARKS, "drift": DRIFT, "shore": SHORE, "px": PX, "dets": DETS, "gts": GTS, "segs": SEGS, "clouds": CLOUDS}


def with_views(sql: str) -> str:
    """``sql`` with the views it names in front, for an engine that has the tables."""
    used = [f"{name} AS ({text})" for name, text in VIEWS.items() if f" {name}" in sql]
    if not used:
        return sql
    head, rest = ", ".join(used), sql.lstrip()
    if rest[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head}, {rest[15:]}"
    return f"WITH {head}, {rest[5:]}" if rest[:5].upper() == "WITH " else f"WITH {head} {rest}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the tables of ``sf_dir``; only the columns it needs are scanned."""
    text = VIEWS[name]
    source = text.rsplit("FROM ", 1)[1].split()[0]
    return spark.sql(text.replace(f"FROM {source}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))
