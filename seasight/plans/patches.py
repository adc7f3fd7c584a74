"""More registered queries: patches, map frames, values at detections, coast reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from seasight.functions import geo
from seasight.operators import detections, patches, screening
from seasight.operators.catalog import CLASSES
from seasight.plans.queries import _FDI, _NDWI, _table, query, r6, s6
from seasight.views import view

c = F.col


@query("patch_quality", """WITH q AS (SELECT tr, tc, count(*) AS n_pixels, avg(CASE WHEN nir IS NULL THEN 1e0 ELSE 0e0 END) AS n, avg(CASE WHEN scl = 6 THEN 1e0 ELSE 0e0 END) AS w, avg(CASE WHEN scl IN (8, 9, 10) THEN 1e0 ELSE 0e0 END) AS k FROM px GROUP BY tr, tc)
SELECT tr, tc, n_pixels, CASE WHEN n > 0.02e0 THEN 'no data' WHEN w < 0.78e0 THEN 'too little water' WHEN k > 0.2e0 THEN 'cloud' ELSE 'good' END AS reason FROM q""")
def patch_quality(spark, sf):
    q = patches.quality(view(spark, sf, "px"), ["tr", "tc"], c("nir").isNull(), 0.78, 0.2)
    return q.select("tr", "tc", "n_pixels", F.coalesce("reason", F.lit("good")).alias("reason"))


def _codes(spark, sf):
    return _table(spark, sf, "events").select("event_id", F.floor(c("event_id") / 2500).alias("roi"), (c("user_id") % 16).alias("code"), (c("event_id") % 3 + 1).alias("confidence"))


_CODES = "SELECT event_id, CAST(floor(event_id / 2500.0e0) AS BIGINT) AS roi, user_id % 16 AS code, event_id % 3 + 1 AS confidence FROM events"


@query("open_water_patches", f"""WITH p AS ({_CODES}), k AS (SELECT roi, count(*) FILTER (WHERE code = 1) AS n, count(*) FILTER (WHERE code <> 0) AS a, count(*) FILTER (WHERE code IN (7, 10, 11, 15)) AS w FROM p GROUP BY roi)
SELECT roi, n FROM k WHERE n >= 8 AND a - w - n <= 0.65e0 * greatest(a, 1) ORDER BY n DESC, roi LIMIT 10""")
def open_water_patches(spark, sf):
    return patches.pick(_codes(spark, sf), "roi", 10, patches.LEAST_DEBRIS, 0.65)


@query("debris_patches", f"WITH p AS ({_CODES}) SELECT roi, count(*) AS n FROM p WHERE code = 1 GROUP BY roi ORDER BY n DESC, roi LIMIT 10")
def debris_patches(spark, sf):
    return patches.pick(_codes(spark, sf), "roi", 10)


_NAMES = "CASE code " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(CLASSES, 1)) + " END"


@query("labelled_pixels", f"WITH p AS ({_CODES}) SELECT event_id, roi, {_NAMES} AS name FROM p WHERE code <> 0 AND confidence >= 2")
def labelled_pixels(spark, sf):
    return patches.labelled(_codes(spark, sf), 2).select("event_id", "roi", "name")


@query("split_labels", """SELECT c_custkey AS roi, array_to_string(list_filter([CASE WHEN s % 2 = 1 THEN 'Marine Debris' END, CASE WHEN (s // 2) % 2 = 1 THEN 'Dense Sargassum' END, CASE WHEN s // 4 = 1 THEN 'Sparse Sargassum' END], lambda x: x IS NOT NULL), ',') AS labels, coalesce(s % 2 = 1, false) AS debris
FROM customer LEFT JOIN (SELECT p_partkey, p_size % 8 AS s FROM part) ON c_custkey = p_partkey""")
def split_labels(spark, sf):
    bits = F.array(*[F.shiftright(c("p_size") % 8, i).bitwiseAND(F.lit(1)) for i in range(3)])
    labels = _table(spark, sf, "part").select(c("p_partkey").alias("roi"), bits.alias("bits"))
    out = patches.split_patches(_table(spark, sf, "customer").select(c("c_custkey").alias("roi")), labels)
    return out.select("roi", F.array_join("labels", ",").alias("labels"), "debris")


@query("training_boxes", "SELECT det_id, label, CASE label WHEN 'marine_debris' THEN 0 ELSE 1 END AS head FROM dets WHERE label IN ('marine_debris', 'ship')")
def training_boxes(spark, sf):
    return patches.training_boxes(view(spark, sf, "dets"), ["marine_debris", "ship"]).select("det_id", "label", "head")


_NORTH = "degrees(atan(sinh(pi() * (1 - 2 * {} / 256.0e0))))"


@query("georeference_tile", f"""WITH t AS (SELECT det_id, xmin, ymin, xmax, ymax, (image % 256) / 256.0e0 * 360 - 180 AS west, 360 / 256.0e0 / 960 AS a, {_NORTH.format('(image * 7 % 256)')} AS north, {_NORTH.format('(image * 7 % 256 + 1)')} AS south FROM dets)
SELECT det_id, {s6('west + a * xmin')} AS west, {s6('north - (north - south) / 960 * ymax')} AS south, {s6('west + a * xmax')} AS east, {s6('north - (north - south) / 960 * ymin')} AS north FROM t""")
def georeference_tile(spark, sf):
    d = view(spark, sf, "dets")
    ring = geo.box_ring(geo.tile_transform(c("image") % 256, c("image") * 7 % 256, F.lit(8), 960))
    axis = lambda k: F.transform(ring, lambda p: p[k])
    ends = {"west": F.array_min(axis("x")), "south": F.array_min(axis("y")), "east": F.array_max(axis("x")), "north": F.array_max(axis("y"))}
    return d.select("det_id", *[r6(v).alias(k) for k, v in ends.items()])


@query("rotated_rings", "SELECT det_id, 5 * xmin - 2 * ymin + 100 AS x0, 5 * xmax - 2 * ymin + 100 AS x1, 5 * xmax - 2 * ymax + 100 AS x2, 5 * xmin - 2 * ymax + 100 AS x3, 2 * xmin + 5 * ymin - 7 AS y0, 2 * xmax + 5 * ymin - 7 AS y1, 2 * xmax + 5 * ymax - 7 AS y2, 2 * xmin + 5 * ymax - 7 AS y3 FROM dets")
def rotated_rings(spark, sf):
    """All four corners go through the transform: a rotated box stays one."""
    r = view(spark, sf, "dets").select("det_id", geo.box_ring((5.0, -2.0, 100.0, 2.0, 5.0, -7.0)).alias("ring"))
    return r.select("det_id", *[F.get("ring", i)[k].alias(f"{k}{i}") for k in "xy" for i in range(4)])


@query("box_area_m2", "SELECT det_id, (xmax - xmin) * (ymax - ymin) * 100 AS area_m2 FROM dets")
def box_area_m2(spark, sf):
    return view(spark, sf, "dets").select("det_id", geo.area_m2(F.lit(10.0)).alias("area_m2"))


_AT = "CAST(least(greatest(round_even((({a}min / 10) + ({a}max / 10)) / 2, 0), 0), {n}) AS BIGINT)"


@query("index_at_centre", f"""WITH p AS (SELECT CAST(floor(r / 10.0e0) AS BIGINT) AS image, r % 10 AS r, c, {_FDI} AS fdi, {_NDWI} AS ndwi FROM px),
d AS (SELECT det_id, image, {_AT.format(a='x', n=99)} AS c, {_AT.format(a='y', n=9)} AS r FROM dets)
SELECT det_id, {s6('fdi')} AS fdi, {s6('ndwi')} AS ndwi FROM d LEFT JOIN p USING (image, r, c)""")
def index_at_centre(spark, sf):
    px = view(spark, sf, "px").withColumns({"image": F.floor(c("r") / 10), "r": c("r") % 10})
    d = view(spark, sf, "dets").withColumns({k: c(k) / 10 for k in detections.BOX})
    return screening.values_at(d, px, ["fdi", "ndwi"], 100, 10).select("det_id", r6(c("fdi")).alias("fdi"), r6(c("ndwi")).alias("ndwi"))


@query("present_labels", "SELECT label, CASE label WHEN 'marine_debris' THEN 1 WHEN 'sargassum' THEN 2 ELSE 3 END AS place FROM (SELECT label FROM dets UNION SELECT label FROM gts)")
def present_labels(spark, sf):
    return detections.present_labels(view(spark, sf, "dets"), view(spark, sf, "gts"))
