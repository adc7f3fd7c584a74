"""Registered queries of boxes, tiles, windows, grids, display, radiometry, prompts, documents and whole scenes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seasight.functions import geo, spectral
from seasight.operators import blocks, catalog, classifier, curves, detections, display, prompts, scene, screening, stacks
from seasight.operators.quantiles import percentiles
from seasight.plans.queries import _CLOUD, _FDI, _NDWI, _SPECTRA, _WATER, _spectra, _table, nms_sql, query, r6, s6
from seasight.settings import Settings
from seasight.sources.documents import PROPERTIES, collections, from_features
from seasight.views import view

c = F.col


# Boxes


@query("box_parts", "SELECT det_id, xmax - xmin AS width, ymax - ymin AS height, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy, xmax >= xmin AND ymax >= ymin AS valid FROM marks")
def box_parts(spark, sf):
    x, y = geo.centre()
    return view(spark, sf, "marks").select("det_id", geo.width().alias("width"), geo.height().alias("height"), x.alias("cx"), y.alias("cy"), geo.valid_pixel_box().alias("valid"))


_RAW_SQL = """WITH n AS (SELECT event_id, user_id % 7 AS cls, value / 400.0e0 AS score, (event_id % 100 - 3) / 100.0e0 AS x0, (event_id % 50) / 45.0e0 AS y0, (event_id % 100 + user_id % 13 - 4) / 100.0e0 AS x1, (event_id % 50 + 6) / 45.0e0 AS y1 FROM events)"""


def _raw(spark, sf):
    e, u = c("event_id"), c("user_id")
    box = F.array((e % 50) / 45.0, (e % 100 - 3) / 100.0, (e % 50 + 6) / 45.0, (e % 100 + u % 13 - 4) / 100.0)
    return _table(spark, sf, "events").select("event_id", (u % 7).alias("class"), (c("value") / 400.0).alias("score"), box.alias("box"))


@query("box_from_normalized", _RAW_SQL + f", k AS (SELECT event_id, least(greatest(x0 * 512, 0), 512) AS xmin, least(greatest(y0 * 300, 0), 300) AS ymin, least(greatest(x1 * 512, 0), 512) AS xmax, least(greatest(y1 * 300, 0), 300) AS ymax, least(greatest(score, 0), 1) AS score, CASE cls WHEN 1 THEN 'ship' WHEN 2 THEN 'cloud' ELSE 'marine_debris' END AS label FROM n WHERE score >= 0.2e0) SELECT event_id, label, {s6('xmin')} AS xmin, {s6('ymin')} AS ymin, {s6('xmax')} AS xmax, {s6('ymax')} AS ymax, {s6('score')} AS score FROM k WHERE xmax >= xmin AND ymax >= ymin")
def box_from_normalized(spark, sf):
    d = scene.to_detections(_raw(spark, sf), 512, 300, {1: "ship", 2: "cloud"}, least=0.2)
    return d.select("event_id", "label", *[r6(c(x)).alias(x) for x in (*detections.BOX, "score")])


@query("targets_only", "SELECT det_id, label = 'marine_debris' AS is_target, label IN ('sargassum', 'ship_wake', 'sea_foam', 'sediment_plume') AS is_confuser FROM marks")
def targets_only(spark, sf):
    l = c("label")
    return view(spark, sf, "marks").select("det_id", detections.is_target(l).alias("is_target"), detections.is_confuser(l).alias("is_confuser"))


_INTER = "greatest(least(d.xmax, g.xmax) - greatest(d.xmin, g.xmin), 0) * greatest(least(d.ymax, g.ymax) - greatest(d.ymin, g.ymin), 0)"
_IOU = f"({_INTER}) / ((d.xmax - d.xmin) * (d.ymax - d.ymin) + (g.xmax - g.xmin) * (g.ymax - g.ymin) - {_INTER})"
# Matching one box after the other, by falling score, as a recursive query.
_GREEDY = f"""WITH RECURSIVE t AS (SELECT gt_id, image, label, xmin - 1 AS xmin, ymin AS ymin, xmax + 3 AS xmax, ymax + 2 AS ymax FROM gts),
p AS (SELECT d.det_id, g.gt_id, d.image, d.score, {_IOU} AS iou FROM marks d JOIN t g ON d.image = g.image AND d.xmin < g.xmax AND g.xmin < d.xmax AND d.ymin < g.ymax AND g.ymin < d.ymax WHERE {_IOU} >= 0.1),
o AS (SELECT image, det_id, row_number() OVER (PARTITION BY image ORDER BY score DESC, det_id) AS k FROM (SELECT DISTINCT image, det_id, score FROM p)),
w AS (SELECT o.image, o.k, o.det_id, list(p.gt_id ORDER BY p.iou DESC, p.gt_id) AS want FROM o JOIN p USING (det_id) GROUP BY ALL),
s AS (SELECT image, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS det_id, CAST(NULL AS BIGINT) AS gt_id FROM (SELECT DISTINCT image FROM w)
  UNION ALL SELECT s.image, w.k, CASE WHEN f.g IS NULL THEN used ELSE list_append(used, f.g) END, w.det_id, f.g FROM s JOIN w ON s.image = w.image AND w.k = s.k + 1, LATERAL (SELECT list_filter(want, lambda x: NOT list_contains(used, x))[1] AS g) f)"""


def _wide_gts(spark, sf):
    return view(spark, sf, "gts").withColumns({"xmin": c("xmin") - 1, "xmax": c("xmax") + 3, "ymax": c("ymax") + 2})


@query("match_overlapping", _GREEDY + " SELECT det_id, gt_id FROM s WHERE gt_id IS NOT NULL")
def match_overlapping(spark, sf):
    """Boxes of many sizes that compete for several truths, whatever their labels."""
    return detections.match(view(spark, sf, "marks"), _wide_gts(spark, sf), 0.1, False).select("det_id", "gt_id")


@query("nms_overlapping", nms_sql("SELECT * FROM marks", "AND d.label = g.label", 0.1))
def nms_overlapping(spark, sf):
    return detections.nms(view(spark, sf, "marks"), 0.1).select("det_id", "label", "score")


@query("nms_across_labels", nms_sql("SELECT * FROM marks", "", 0.3))
def nms_across_labels(spark, sf):
    return detections.nms(view(spark, sf, "marks"), 0.3, ("image",)).select("det_id", "label", "score")


# Tiles and windows


@query("parse_tile_name", "SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN p_partkey % 1024 ELSE -1 END AS x, CASE WHEN p_partkey % 5 < 3 THEN p_partkey * 7 % 1024 ELSE -1 END AS y, CASE WHEN p_partkey % 5 < 3 THEN 10 ELSE -1 END AS z FROM part")
def parse_tile_name(spark, sf):
    """Of five names one has too few parts and one names no tile of its zoom."""
    k = c("p_partkey")
    tile = F.concat(k % 1024, F.lit("-"), k * 7 % 1024, F.lit("-10"))
    name = F.when(k % 5 == 0, F.concat(F.lit("tiles/scene-a-"), tile, F.lit(".png"))).when(k % 5 == 1, F.concat(F.lit("c:\\x\\"), tile, F.lit(".jpg"))).when(k % 5 == 2, tile)
    name = name.when(k % 5 == 3, "tiles/a-10.png").otherwise(F.concat(F.lit("9-"), k % 1024 + 8, F.lit("-3")))
    t = _table(spark, sf, "part").select("p_partkey", geo.parse_tile_name(name).alias("t"))
    return t.select("p_partkey", *[F.coalesce(f"t.{k}", F.lit(-1)).alias(k) for k in "xyz"])


@query("num2deg", f"WITH t AS (SELECT p_partkey, p_partkey % 1024 AS x, p_partkey * 7 % 1024 AS y FROM part) SELECT p_partkey, {s6('x / 1024.0e0 * 360 - 180')} AS lon, {s6('degrees(atan(sinh(pi() * (1 - 2 * y / 1024.0e0))))')} AS lat FROM t")
def num2deg(spark, sf):
    k, z = c("p_partkey"), F.lit(10)
    return _table(spark, sf, "part").select("p_partkey", r6(geo.tile_lon(k % 1024, z)).alias("lon"), r6(geo.tile_lat(k * 7 % 1024, z)).alias("lat"))


def _merc(lat: str) -> str:
    return f"(1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * 64"


@query("xyz_tiles", f"""WITH b AS (SELECT c_custkey, c_custkey % 350 - 179.5e0 AS west, c_custkey % 120 - 60.3e0 AS south, (c_custkey % 350 + 11 + 180) % 360 - 180 + 0.3e0 AS east, c_custkey % 120 - 60.3e0 + c_custkey % 9 AS north FROM customer),
t AS (SELECT c_custkey, west > east AS wraps, CAST(floor((west + 180) / 360 * 64) AS BIGINT) AS x0, CAST(floor((east + 180) / 360 * 64) AS BIGINT) AS x1, CAST(floor({_merc('north')}) AS BIGINT) AS y0, CAST(floor({_merc('south')}) AS BIGINT) AS y1 FROM b),
x AS (SELECT c_custkey, y0, y1, unnest(CASE WHEN wraps THEN list_concat(range(0, x1 + 1), range(x0, 64)) ELSE range(x0, x1 + 1) END) AS x FROM t)
SELECT c_custkey, x, unnest(range(y0, y1 + 1)) AS y FROM x""")
def xyz_tiles(spark, sf):
    """Tiles of zoom 6 that boxes reach, across the date line too."""
    k = c("c_custkey")
    box = {"west": k % 350 - 179.5, "south": k % 120 - 60.3, "east": (k % 350 + 191) % 360 - 180 + 0.3, "north": k % 120 - 60.3 + k % 9}
    b = _table(spark, sf, "customer").select("c_custkey", *[v.cast("double").alias(n) for n, v in box.items()])
    return b.select("c_custkey", F.explode(geo.tiles_of_box(c("west"), c("south"), c("east"), c("north"), 6)).alias("t")).select("c_custkey", "t.x", "t.y")


@query("windows_for_raster", """WITH e AS (SELECT c_custkey, 100 + c_custkey % 900 AS w, 80 + c_custkey % 700 AS h FROM customer),
a AS (SELECT c_custkey, w, h, unnest(range(0, CASE WHEN w <= 256 THEN 1 ELSE w - 256 + 1 END, 224)) AS x FROM e),
b AS (SELECT * FROM a UNION SELECT c_custkey, w, h, max(x) + 224 FROM a GROUP BY c_custkey, w, h HAVING max(x) + 256 < w),
d AS (SELECT *, unnest(range(0, CASE WHEN h <= 256 THEN 1 ELSE h - 256 + 1 END, 224)) AS y FROM b),
f AS (SELECT * FROM d UNION SELECT c_custkey, w, h, x, max(y) + 224 FROM d GROUP BY c_custkey, w, h, x HAVING max(y) + 256 < h)
SELECT c_custkey, x AS col_off, y AS row_off, least(256, w - x) AS width, least(256, h - y) AS height FROM f""")
def windows_for_raster(spark, sf):
    e = _table(spark, sf, "customer").select("c_custkey", F.explode(geo.windows_of(100 + c("c_custkey") % 900, 80 + c("c_custkey") % 700, 256, 32)).alias("w"))
    return e.select("c_custkey", "w.*")


@query("window_pixels", """WITH m AS (SELECT max(r) + 1 AS h FROM px), y AS (SELECT unnest(list_distinct(list_concat(range(0, CASE WHEN h <= 40 THEN 1 ELSE h - 40 + 1 END, 30), CASE WHEN h > 40 THEN [CAST(ceil((h - 40) / 30e0) AS BIGINT) * 30] ELSE [0] END))) AS row_off FROM m), x AS (SELECT unnest([0, 30, 60]) AS col_off)
SELECT row_off, col_off, count(*) AS n, min(pid) AS first_pid FROM px JOIN y ON r >= row_off AND r < row_off + 40 JOIN x ON c >= col_off AND c < col_off + 40 GROUP BY ALL""")
def window_pixels(spark, sf):
    """Pixels of overlapping windows over the whole scene."""
    px = view(spark, sf, "px")
    h = px.agg(F.max("r") + 1).first()[0]
    return display.window_pixels(px, 40, 10, 100, h).groupBy("row_off", "col_off").agg(F.count("*").alias("n"), F.min("pid").alias("first_pid"))


# Grids


@query("regrid_nearest", "SELECT CAST(floor(r / 2.0e0) AS BIGINT) AS r, CAST(floor(c / 2.0e0) AS BIGINT) AS c, pid, nir FROM px WHERE r % 2 = 0 AND c % 2 = 0")
def regrid_nearest(spark, sf):
    return display.coarsen(view(spark, sf, "px"), 2, ["pid", "nir"])


@query("regrid_bilinear", """WITH k AS (SELECT * FROM (VALUES (-1, 0.25e0), (0, 0.75e0), (1, 0.75e0), (2, 0.25e0)) AS k(d, w)),
o AS (SELECT r * 2 + a.d AS r2, c * 2 + b.d AS c2, nir, a.w * b.w AS w FROM px, k a, k b WHERE nir IS NOT NULL)
SELECT r2 AS r, c2 AS c, floor(sum(nir * w) / sum(w) * 1e11 + 0.5e0) / 1e11 AS nir FROM o GROUP BY r2, c2""")
def regrid_bilinear(spark, sf):
    """To half the pixel size. Sixteenths end before the last digit kept."""
    return display.refine(view(spark, sf, "px"), "nir").select("r", "c", (F.floor(c("nir") * 1e11 + 0.5) / 1e11).alias("nir"))


# Display


@query("rgb_stretch", "WITH q AS (SELECT " + ", ".join(f"quantile_cont({b}, 0.02e0) AS lo_{b}, quantile_cont({b}, 0.98e0) AS hi_{b}" for b in ("red", "green", "swir1")) + " FROM px) SELECT pid, " + ", ".join(f"CAST(round_even(CASE WHEN hi_{b} <= lo_{b} THEN 0.5e0 ELSE least(greatest((coalesce({b}, lo_{b}) - lo_{b}) / (hi_{b} - lo_{b}), 0), 1) END * 255, 0) AS INT) AS {n}" for b, n in (("red", "r8"), ("green", "g8"), ("swir1", "b8"))) + " FROM px, q")
def rgb_stretch(spark, sf):
    """Short-wave infrared in the place of blue, which the view lacks."""
    px = view(spark, sf, "px").select("pid", "red", "green", c("swir1").alias("blue"))
    return display.to_rgb(px).select("pid", "r8", "g8", "b8")


@query("stretch_joint", "WITH u AS (SELECT red AS v FROM px UNION ALL SELECT nir FROM px), q AS (SELECT quantile_cont(v, 0.02e0) AS lo, quantile_cont(v, 0.98e0) AS hi FROM u) SELECT pid, CAST(floor(least(greatest((red - lo) / (hi - lo), 0), 1) * 255) AS INT) AS red8, coalesce(CAST(floor(least(greatest((nir - lo) / (hi - lo), 0), 1) * 255) AS INT), 0) AS nir8 FROM px, q")
def stretch_joint(spark, sf):
    """One stretch for all channels; no data is black."""
    return display.stretch(view(spark, sf, "px"), ["red", "nir"], per_channel=False).select("pid", "red8", c("nir8"))


@query("fdi_histogram", f"WITH f AS (SELECT {_FDI} AS v FROM px WHERE {_WATER} AND NOT {_CLOUD}), q AS (SELECT quantile_cont(v, 0.005e0) AS lo, quantile_cont(v, 0.9995e0) AS hi FROM f), b AS (SELECT least(CAST(floor((v - lo) / ((hi - lo) / 90)) AS BIGINT), 89) AS bin FROM f, q WHERE v BETWEEN lo AND hi) SELECT bin, count(*) AS n FROM b GROUP BY bin")
def fdi_histogram(spark, sf):
    f = view(spark, sf, "px").filter(spectral.water_mask() & ~spectral.cloud_mask()).select(spectral.INDICES["fdi"][1]().alias("fdi"))
    return display.histogram(f, "fdi").select("bin", "n")


@query("clean_vs_naive_threshold", f"WITH f AS (SELECT {_FDI} AS fdi, {_WATER} AND NOT {_CLOUD} AS clean FROM px) SELECT 'clean' AS water, {s6('quantile_cont(fdi, 0.999e0) FILTER (WHERE clean)')} AS threshold FROM f UNION ALL SELECT 'naive', {s6('quantile_cont(fdi, 0.999e0)')} FROM f")
def clean_vs_naive_threshold(spark, sf):
    f = view(spark, sf, "px").select(spectral.INDICES["fdi"][1]().alias("fdi"), (spectral.water_mask() & ~spectral.cloud_mask()).alias("clean"))
    both = f.filter("clean").select(F.lit("clean").alias("water"), "fdi").union(f.select(F.lit("naive"), "fdi"))
    return percentiles(both, "fdi", {"t": 0.999}, ("water",)).select("water", r6(c("t")).alias("threshold"))


@query("crop_boxes", """WITH m AS (SELECT tr, tc, min(c) FILTER (WHERE scl = 3) - 5 AS x0, max(c) FILTER (WHERE scl = 3) + 6 AS x1, min(r) FILTER (WHERE scl = 3) - 5 AS y0, max(r) FILTER (WHERE scl = 3) + 6 AS y1 FROM px GROUP BY tr, tc),
g AS (SELECT tr, tc, CASE WHEN x1 - x0 < 24 THEN CAST(floor((x0 + x1) / 2e0) AS BIGINT) - 12 ELSE x0 END AS x0, CASE WHEN x1 - x0 < 24 THEN CAST(floor((x0 + x1) / 2e0) AS BIGINT) + 12 ELSE x1 END AS x1,
  CASE WHEN y1 - y0 < 24 THEN CAST(floor((y0 + y1) / 2e0) AS BIGINT) - 12 ELSE y0 END AS y0, CASE WHEN y1 - y0 < 24 THEN CAST(floor((y0 + y1) / 2e0) AS BIGINT) + 12 ELSE y1 END AS y1 FROM m)
SELECT tr, tc, coalesce(greatest(x0, 0), 0) AS x0, coalesce(least(x1, 100), 100) AS x1, coalesce(greatest(y0, 0), 0) AS y0, coalesce(least(y1, 1000), 1000) AS y1 FROM g""")
def crop_boxes(spark, sf):
    """A padded box around each tile's cloud shadow, grown to 24 pixels, inside the scene; all of it where there is none."""
    return display.crops(view(spark, sf, "px"), ["tr", "tc"], c("scl") == 3, 100, 1000, 5, 24)


# Radiometry


@query("scale_bands", f"SELECT l_orderkey, l_linenumber, {s6('CAST(CAST(l_quantity * 100 AS FLOAT) * CAST(0.0001e0 AS FLOAT) + CAST(-0.1e0 AS FLOAT) AS DOUBLE)')} AS red, l_linenumber % 12 AS scl, l_partkey AS other FROM lineitem")
def scale_bands(spark, sf):
    """A whole table at once: the class layer and a column without a band stay."""
    t = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (c("l_quantity") * 100).alias("red"), (c("l_linenumber") % 12).alias("scl"), c("l_partkey").alias("other"))
    out = spectral.scale_bands(t, {"red": "B04", "scl": "SCL"})
    return out.withColumn("red", r6(c("red").cast("double")))


@query("item_params", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0.0002e0 ELSE 0.0001e0 END AS scale, CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN -0.2e0 ELSE 0e0 END WHEN p_size % 5 >= 4 OR p_size % 5 = 0 THEN -0.1e0 ELSE 0e0 END AS offset_ FROM part")
def item_params(spark, sf):
    """An item's own figures where a reflectance asset has them, else its processing baseline's."""
    s = c("p_size")
    asset = lambda band, scale, offset: F.struct(F.lit(band).cast("string").alias("band"), scale.cast("double").alias("scale"), offset.cast("double").alias("offset"))
    none = F.lit(None)
    assets = F.array(asset(None, F.lit(9.0), none), asset("SCL", F.lit(9.0), none), asset("B02", none, none), asset("B04", F.when(s % 3 == 0, 0.0002), F.when(s % 2 == 0, -0.2)))
    baseline = F.when(s % 5 > 0, F.concat(F.lit("0"), s % 5, F.lit(".00")))
    p = spectral.item_params(assets, baseline)
    return _table(spark, sf, "part").select("p_partkey", p["scale"].alias("scale"), p["offset"].alias("offset_"))


# Prompts and classes


@query("prompt_index", "SELECT p_partkey, CASE WHEN p_size % 10 IN (0, 1) THEN 'marine_debris' WHEN p_size % 10 = 2 THEN 'sargassum' WHEN p_size % 10 = 3 THEN 'ship' WHEN p_size % 10 = 4 THEN 'sea_foam' WHEN p_size % 10 = 5 THEN 'open_water' ELSE 'unknown' END AS label FROM part")
def prompt_index(spark, sf):
    return _table(spark, sf, "part").select("p_partkey", prompts.MINIMAL.label_for_index(c("p_size") % 10).alias("label"))


@query("class_codes", "SELECT p_partkey, p_size % 15 + 1 AS code FROM part")
def class_codes(spark, sf):
    """From code to name and back."""
    return _table(spark, sf, "part").select("p_partkey", catalog.class_code(catalog.class_name(c("p_size") % 15 + 1)).alias("code"))


@query("patch_sites", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Haiti' WHEN 1 THEN 'Scotland' ELSE '99ZZZ' END AS site FROM part")
def patch_sites(spark, sf):
    roi = F.concat(F.lit("1-12-19_"), F.element_at(F.array(F.lit("18QYF"), F.lit("30VWH"), F.lit("99ZZZ")), (c("p_size") % 3 + 1).cast("int")), F.lit("_0"))
    return _table(spark, sf, "part").select("p_partkey", catalog.site(catalog.roi_tile(roi)).alias("site"))


# Classifiers


@query("class_balance", f"WITH x AS ({_SPECTRA}) SELECT truth, count(*) AS n, {s6('count(*) / (SELECT count(*) FROM x)')} AS share, count(*) FILTER (WHERE pred <> truth) AS missed FROM x GROUP BY truth")
def class_balance(spark, sf):
    """Over counts by class, a row each."""
    from pyspark.sql import Window

    n = _spectra(spark, sf).groupBy("truth").agg(F.count("*").alias("n"), F.count_if(c("pred") != c("truth")).alias("missed"))
    return n.select("truth", "n", r6(c("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"), "missed")


@query("training_scores", f"WITH x AS ({_SPECTRA}), l AS (SELECT truth AS k FROM x UNION SELECT pred FROM x), f AS (SELECT k, 2 * count(*) FILTER (WHERE truth = k AND pred = k) / (count(*) FILTER (WHERE truth = k) + count(*) FILTER (WHERE pred = k)) AS f1 FROM x, l GROUP BY k) SELECT (SELECT count(*) FROM x) AS n, {s6('(SELECT avg(CASE WHEN pred = truth THEN 1e0 ELSE 0e0 END) FROM x)')} AS accuracy, {s6('(SELECT avg(f1) FROM f)')} AS macro_f1")
def training_scores(spark, sf):
    k = _spectra(spark, sf).groupBy("truth", "pred").agg(F.count("*").alias("n"))
    return curves.overall(k).select("n", r6(c("accuracy")).alias("accuracy"), r6(c("macro_f1")).alias("macro_f1"))


@query("agreement_annotated", f"WITH x AS ({_SPECTRA}) SELECT count(*) AS n, {s6('avg(CASE WHEN pred = truth THEN 1e0 ELSE 0e0 END)')} AS agreement FROM x WHERE truth > 0")
def agreement_annotated(spark, sf):
    k = _spectra(spark, sf).filter("truth > 0").groupBy("truth", "pred").agg(F.count("*").alias("n"))
    return curves.overall(k).select("n", r6(c("accuracy")).alias("agreement"))


@query("best_threshold", f"""WITH x AS (SELECT vec_id, label = 3 AS pos, embedding[1] AS s FROM embeddings), k AS (SELECT s, sum(CASE WHEN pos THEN 1 ELSE 0 END) OVER (ORDER BY s DESC, vec_id ROWS UNBOUNDED PRECEDING) AS tp, row_number() OVER (ORDER BY s DESC, vec_id) AS n, (SELECT count(*) FROM x WHERE pos) AS all_pos FROM x)
SELECT {s6('s')} AS threshold, {s6('tp / n')} AS precision, {s6('tp / all_pos')} AS recall, {s6('2 * tp / (n + all_pos)')} AS f1 FROM k ORDER BY 2 * tp / (n + all_pos) DESC, s DESC LIMIT 1""")
def best_threshold(spark, sf):
    x = _table(spark, sf, "embeddings").select(c("vec_id").alias("id"), (c("label") == 3).cast("long").alias("pos"), F.element_at("embedding", 1).cast("double").alias("score"))
    return curves.best_threshold(x).select(*[r6(c(n)).alias(n) for n in ("threshold", "precision", "recall", "f1")])


# Documents and scenes


@query("collections_roundtrip", f"SELECT det_id % 1000 AS k, image, label, {s6('score')} AS score, {s6('(xmax - xmin) * (ymax - ymin) * 100')} AS area_m2, 'scene-' || image AS scene_id FROM marks")
def collections_roundtrip(spark, sf):
    """A collection per scene, with crs and count, and its features read back."""
    d = view(spark, sf, "marks").withColumns({"gsd_m": F.lit(10.0), "scene_id": F.concat(F.lit("scene-"), "image"), "tile": (c("det_id") % 1000).cast("string")})
    inner = ",".join(f"{x.split()[0]}:{x.split()[1]}" for x in PROPERTIES.split(", "))
    shape = f"crs struct<properties:struct<name:string>>, features array<struct<geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:struct<{inner}>>>, properties struct<count:bigint>"
    back = collections(d).select("image", F.from_json("value", shape).alias("v")).filter("size(v.features) = v.properties.count and v.crs is not null")
    f = back.select("image", F.explode("v.features").alias("f")).withColumn("f", F.col("f"))
    flat = f.select("image", "f", F.struct("f").alias("x"))
    return flat.select(c("f.properties.tile").cast("long").alias("k"), "image", c("f.properties.label").alias("label"), r6(c("f.properties.score")).alias("score"), r6(c("f.properties.area_m2")).alias("area_m2"), c("f.properties.scene_id").alias("scene_id"))


_SMALL = Settings(tile_size=64, tile_overlap=16, score_threshold=0.1, nms_iou=0.5)


def bright(bands):
    """A detector to test with: every 8 x 8 pixels, from the window's corner, whose mean near infrared is above a limit."""
    nir = bands["nir"]
    for r in range(0, nir.shape[0], 8):
        for c0 in range(0, nir.shape[1], 8):
            part = nir[r : r + 8, c0 : c0 + 8]
            good = part[np.isfinite(part)]
            mean = np.cumsum(good)[-1] / len(good) if len(good) else 0.0  # added up pixel by pixel, as avg() does: a mean at the limit is on the same side
            if mean > 0.0075:
                yield float(c0), float(r), c0 + 8.0, r + 8.0, "marine_debris", float(np.floor(mean * 4e7 + 0.501) / 1e6)


@query("scene_detect", """WITH m AS (SELECT max(r) + 1 AS h FROM px), y AS (SELECT unnest(range(0, CASE WHEN h <= 64 THEN 1 ELSE CAST(ceil((h - 64) / 48e0) AS BIGINT) * 48 + 1 END, 48)) AS row_off FROM m), x AS (SELECT unnest([0, 48]) AS col_off),
b AS (SELECT row_off, col_off, (r - row_off) // 8 AS i, (c - col_off) // 8 AS j, avg(nir) AS v FROM px JOIN y ON r >= row_off AND r < row_off + 64 JOIN x ON c >= col_off AND c < col_off + 64 GROUP BY ALL),
k AS (SELECT DISTINCT col_off + 8 * j AS xmin, row_off + 8 * i AS ymin, least(col_off + 8 * j + 8, 100) AS xmax, least(row_off + 8 * i + 8, h) AS ymax, floor(v * 4e7 + 0.501e0) / 1e6 AS score FROM b, m WHERE v > 0.0075e0)
SELECT CAST(xmin AS DOUBLE) AS xmin, CAST(ymin AS DOUBLE) AS ymin, CAST(xmax AS DOUBLE) AS xmax, CAST(ymax AS DOUBLE) AS ymax, score, CAST(xmin * 10 + 300000 AS DOUBLE) AS west, CAST(4000000 - ymin * 10 AS DOUBLE) AS north FROM k""")
def scene_detect(spark, sf):
    """The whole path over one scene: windows, their bands to the detector, seams, map coordinates."""
    px = view(spark, sf, "px").withColumn("image", F.lit(0).cast("long"))
    h = px.agg(F.max("r") + 1).first()[0]
    found, _ = scene.detect(px, blocks.per_window(bright), 100, int(h), _SMALL, screened=False, transform=(10.0, 0.0, 300000.0, 0.0, -10.0, 4000000.0), scene_id="s", dtype="float64")
    ring = lambda k: F.get("ring", 0)[k]
    return found.select(*detections.BOX, "score", ring("x").alias("west"), ring("y").alias("north"))


@query("window_blocks", """WITH m AS (SELECT max(r) + 1 AS h FROM px), y AS (SELECT unnest(range(0, CASE WHEN h <= 64 THEN 1 ELSE CAST(ceil((h - 64) / 48e0) AS BIGINT) * 48 + 1 END, 48)) AS row_off FROM m), x AS (SELECT unnest([0, 48]) AS col_off)
SELECT row_off, col_off, CAST(least(64, h - row_off) AS INT) AS height, CAST(least(64, 100 - col_off) AS INT) AS width, count(nir) AS n_nir, CAST(sum(scl) AS BIGINT) AS sum_scl FROM px JOIN y ON r >= row_off AND r < row_off + 64 JOIN x ON c >= col_off AND c < col_off + 64, m GROUP BY ALL""")
def window_blocks(spark, sf):
    """What the blocks of all windows hold, by what a detector makes of them."""
    px = view(spark, sf, "px").withColumn("image", F.lit(0).cast("long"))
    h = int(px.agg(F.max("r") + 1).first()[0])
    wanted = display.window_pixels(px, 64, 16, 100, h).select(*blocks.WINDOW).distinct()
    b = blocks.blocks(blocks.stretches(px, ["nir", "scl"], 32), wanted, 100, h, 64, 16)

    def count(frames):
        for f in frames:
            each = [blocks.arrays(x) for x in f.to_dict("records")]
            yield f[["row_off", "col_off", "height", "width"]].assign(n_nir=[int(np.isfinite(a["nir"]).sum()) for a in each], sum_scl=[int(a["scl"].sum()) for a in each])

    return blocks.detect(b, count, "row_off long, col_off long, height int, width int, n_nir long, sum_scl long")


@query("band_stack", f"""WITH n AS (SELECT r // 2 AS r, c // 2 AS c, avg(nir) AS nir FROM px GROUP BY 1, 2), k AS (SELECT r // 2 AS r, c // 2 AS c, scl, count(*) AS n FROM px GROUP BY 1, 2, 3),
s AS (SELECT r, c, arg_min(scl, -n * 100 + scl) AS scl FROM k GROUP BY r, c), g AS (SELECT r // 2 AS r, c // 2 AS c, any_value(red) AS red FROM px WHERE r % 2 = 0 AND c % 2 = 0 GROUP BY 1, 2)
SELECT r, c, {s6('100 * nir')} AS nir, CAST(scl AS DOUBLE) AS scl, red FROM n JOIN s USING (r, c) JOIN g USING (r, c)""")
def band_stack(spark, sf):
    """Near infrared and classes of the scene on a grid of twice the pixel size, beside a band that has it."""
    px = view(spark, sf, "px")

    def rows(band, value, every=1):
        own = px.filter((c("r") % every == 0) & (c("c") % every == 0)).select(F.floor(c("r") / every).alias("r"), F.floor(c("c") / every).alias("c"), value.cast("double").alias("v"))
        own = own.groupBy("r", (F.floor(c("c") / 16) * 16).cast("long").alias("c0")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda x: x["v"]).alias("values"))
        return own.select(F.lit("s").alias("path"), F.lit(band).alias("band"), "r", "c0", "values")

    stack = stacks.stack(rows("nir", c("nir")).union(rows("scl", c("scl"))).union(rows("red", c("red"), 2)), {"nir": 10, "scl": 10, "red": 20}, 20)
    p = stacks.pixels(stacks.resample(stack, 20, 20, "nearest"), ["nir", "scl", "red"])
    return p.select("r", "c", r6(100 * c("nir")).alias("nir"), "scl", "red")


@query("scene_screened", f"""WITH RECURSIVE w AS (SELECT unnest([0, 50]) AS col_off), h AS (SELECT max(r) + 1 AS h FROM px), y AS (SELECT unnest(range(0, CASE WHEN h <= 64 THEN 1 ELSE CAST(ceil((h - 64) / 50e0) AS BIGINT) * 50 + 1 END, 50)) AS row_off FROM h),
p AS (SELECT row_off, col_off, {_FDI} AS fdi, {_WATER} AND NOT {_CLOUD} AS clean FROM px JOIN y ON r >= row_off AND r < row_off + 64 JOIN w ON c >= col_off AND c < col_off + 64),
t AS (SELECT row_off, col_off, greatest(0.006e0, coalesce(quantile_cont(fdi, 0.95e0) FILTER (WHERE clean), 0.006e0)) AS t FROM p GROUP BY ALL)
SELECT row_off, col_off, count(*) AS n_pixels, count(*) FILTER (WHERE clean AND fdi > t) AS candidate_pixels FROM p JOIN t USING (row_off, col_off) GROUP BY ALL""")
def scene_screened(spark, sf):
    """How the windows of the path were screened."""
    px = view(spark, sf, "px").withColumn("image", F.lit(0).cast("long"))
    h = px.agg(F.max("r") + 1).first()[0]
    wide = display.window_pixels(px, 64, 14, 100, int(h)).withColumns({"tr": c("row_off"), "tc": c("col_off")})
    return screening.screen(wide, 0.95, tile=scene.WINDOW).select("row_off", "col_off", "n_pixels", "candidate_pixels")


@query("forest_importance")
def forest_importance(spark, sf):
    """No SQL: each feature's share of the forest's gain, learned from two thirds of the rows."""
    names = [f"f{i}" for i in range(64)]
    e = _table(spark, sf, "embeddings").filter("embedding is not null").select("vec_id", "label", *[F.get("embedding", i).alias(n) for i, n in enumerate(names)])
    model = classifier.fit(e.filter("vec_id % 3 <> 1"), names, trees=20, depth=6)
    return spark.createDataFrame([(n, round(v, 6)) for n, v in classifier.importances(model)], "feature string, share double")
