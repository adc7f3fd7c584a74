"""The registered queries: each an operator over the test tables, with the SQL that says the same."""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seasight.functions import geo, spectral
from seasight.operators import catalog, curves, detections, screening
from seasight.operators.quantiles import percentiles
from seasight.sources.documents import features, from_features, FEATURES
from seasight.views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql)
        return f

    return put


def r6(c: Column) -> Column:
    """Six digits, alike in both engines."""
    return F.floor(c * 1e6 + 0.5) / 1e6


def s6(e: str) -> str:
    return f"floor(({e}) * 1e6 + 0.5e0) / 1e6"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_ND = "CASE WHEN abs({a} + {b}) > 1e-12 THEN ({a} - {b}) / ({a} + {b}) END"
_FDI = "nir - (rededge2 + (swir1 - rededge2) * 1.7777777777777777e0)"
_NDWI = _ND.format(a="green", b="nir")
_WATER = f"coalesce({_NDWI} > 0, false)"
_CLOUD = "scl IN (0, 1, 3, 8, 9, 10)"
INDEX_SQL = {
    "fdi": _FDI,
    "fdi_b04": "nir - (red + (swir1 - red) * 1.7777777777777777e0)",
    "fdi_usgs": "nir - (rededge2 + (swir1 - rededge2) * (177.0e0 / 945.0e0 * 10e0))",
    "fai": "nir - (red + (swir1 - red) * (168.0e0 / 945.0e0))",
    "ndvi": _ND.format(a="nir", b="red"),
    "ndwi": _NDWI,
    "mndwi": _ND.format(a="green", b="swir1"),
    "ndmi": _ND.format(a="nir", b="swir1"),
    "rndvi": _ND.format(a="red", b="nir"),
    "pi": "CASE WHEN abs(nir + red) > 1e-12 THEN nir / (nir + red) END",
    "kndvi": f"tanh(pow({_ND.format(a='nir', b='red')}, 2))",
}


def _one_index(name: str) -> None:
    @query(f"idx_{name}", f"SELECT pid, {s6(INDEX_SQL[name])} AS value FROM px")
    def run(spark, sf):
        return view(spark, sf, "px").select("pid", r6(spectral.INDICES[name][1]()).alias("value"))


for _name in INDEX_SQL:
    _one_index(_name)


@query("all_indices", "SELECT pid, " + ", ".join(f"{s6(e)} AS {n}" for n, e in INDEX_SQL.items()) + " FROM px")
def all_indices(spark, sf):
    return spectral.compute_indices(view(spark, sf, "px")).select("pid", *[r6(F.col(n)).alias(n) for n in INDEX_SQL])


@query("masks", f"SELECT pid, {_WATER} AS water, {_CLOUD} AS cloud, {_WATER} AND coalesce({_FDI} > 0.006e0, false) AND NOT {_CLOUD} AS candidate, scl = 9 AS own_cloud FROM px")
def masks(spark, sf):
    px = view(spark, sf, "px")
    return px.select("pid", spectral.water_mask().alias("water"), spectral.cloud_mask().alias("cloud"), spectral.candidate_mask(px.columns).alias("candidate"), spectral.cloud_mask(classes=(9,)).alias("own_cloud"))


@query("scale_reflectance", f"SELECT l_orderkey, l_linenumber, {s6('l_quantity * 100 * 1e-4 + CASE WHEN l_linenumber >= 4 THEN -0.1e0 ELSE 0e0 END')} AS reflectance FROM lineitem")
def scale_reflectance(spark, sf):
    offset = spectral.baseline_offset(F.col("l_linenumber").cast("string"))
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(spectral.to_reflectance(F.col("l_quantity") * 100, offset)).alias("reflectance"))


@query("baseline_params", "SELECT s_name, CASE WHEN coalesce(TRY_CAST(substr(s_name, 18, 1) AS DOUBLE), 4) >= 4 THEN -0.1e0 ELSE 0e0 END AS value FROM supplier")
def baseline_params(spark, sf):
    return _table(spark, sf, "supplier").select("s_name", spectral.baseline_offset(F.substring("s_name", 18, 1)).alias("value"))


_CANDIDATES = f"""f AS (SELECT *, {_FDI} AS fdi, {_WATER} AND NOT {_CLOUD} AS clean FROM px),
t AS (SELECT tr, tc, count(*) AS n_pixels, greatest(0.006e0, coalesce(quantile_cont(fdi, 0.95e0) FILTER (WHERE clean), 0.006e0)) AS threshold FROM f GROUP BY tr, tc),
m AS (SELECT f.*, t.threshold, f.clean AND coalesce(f.fdi > t.threshold, false) AS candidate FROM f JOIN t USING (tr, tc))"""


@query("screen_tiles", f"WITH {_CANDIDATES} SELECT tr, tc, count(*) AS n_pixels, {s6('min(threshold)')} AS threshold, count(*) FILTER (WHERE candidate) AS candidate_pixels, count(*) FILTER (WHERE candidate) >= 4 AS enough FROM m GROUP BY tr, tc")
def screen_tiles(spark, sf):
    p = screening.candidates(view(spark, sf, "px"), 0.95)
    n = F.count_if("candidate")
    return p.groupBy("tr", "tc").agg(F.count("*").alias("n_pixels"), r6(F.min("threshold")).alias("threshold"), n.alias("candidate_pixels"), (n >= 4).alias("enough"))


def _regions(connectivity: int, least: int) -> str:
    near = "abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1" if connectivity == 8 else "abs(a.r - b.r) + abs(a.c - b.c) = 1"
    return f"""WITH RECURSIVE {_CANDIDATES},
k AS (SELECT tr, tc, r, c, pid FROM m WHERE candidate),
reach AS (SELECT tr, tc, r, c, pid, pid AS root FROM k UNION SELECT b.tr, b.tc, b.r, b.c, b.pid, a.root FROM reach a JOIN k b ON a.tr = b.tr AND a.tc = b.tc AND {near}),
l AS (SELECT tr, tc, r, c, pid, min(root) AS root FROM reach GROUP BY ALL),
regions AS (SELECT tr, tc, min(c) AS xmin, min(r) AS ymin, max(c) + 1 AS xmax, max(r) + 1 AS ymax, count(*) AS n_pixels FROM l GROUP BY tr, tc, root HAVING count(*) >= {least})
"""


def _one_connectivity(n: int) -> None:
    @query(f"components_{n}", _regions(n, 2) + "SELECT * FROM regions")
    def run(spark, sf):
        return screening.regions(screening.candidates(view(spark, sf, "px"), 0.95), connectivity=n, least=2)


_one_connectivity(8)
_one_connectivity(4)

_VERDICTS = (
    _regions(8, 8).rstrip()
    + f""",
n AS (SELECT tr, tc, count(*) AS n_regions FROM regions GROUP BY tr, tc),
s AS (SELECT tr, tc, count(*) FILTER (WHERE candidate) AS candidate_pixels FROM m GROUP BY tr, tc),
v AS (SELECT s.tr, s.tc, candidate_pixels, CASE WHEN candidate_pixels < 4 THEN 0 ELSE coalesce(n_regions, 0) END AS n_regions FROM s LEFT JOIN n USING (tr, tc))
"""
)


@query("screen_verdicts", _VERDICTS + "SELECT tr, tc, candidate_pixels, n_regions, n_regions > 0 AS accepted, CASE WHEN candidate_pixels < 4 THEN 'too few candidate pixels' WHEN n_regions = 0 THEN 'no region large enough' ELSE 'candidate region' END AS reason, " + s6("candidate_pixels / n_pixels") + " AS candidate_fraction FROM v JOIN (SELECT tr, tc, count(*) AS n_pixels FROM px GROUP BY tr, tc) USING (tr, tc)")
def screen_verdicts(spark, sf):
    return screening.screen(view(spark, sf, "px"), 0.95).select("tr", "tc", "candidate_pixels", "n_regions", "accepted", "reason", r6(F.col("candidate_fraction")).alias("candidate_fraction"))


@query("screen_summary", _VERDICTS + "SELECT count(*) AS n_tiles, count(*) FILTER (WHERE n_regions > 0) AS n_accepted, round_even(count(*) FILTER (WHERE n_regions > 0) / count(*), 4) AS accept_rate, round_even(1 - count(*) FILTER (WHERE n_regions > 0) / count(*), 4) AS work_avoided, CAST(sum(candidate_pixels) AS BIGINT) AS candidate_pixels FROM v")
def screen_summary(spark, sf):
    return screening.summary(screening.screen(view(spark, sf, "px"), 0.95))


@query(
    "index_stats",
    "WITH u AS (" + " UNION ALL ".join(f"SELECT '{n}' AS \"index\", {INDEX_SQL[n]} AS v, {_WATER} AS water FROM px" for n in ("fdi", "ndvi", "ndwi")) + f") SELECT \"index\", {s6('avg(v)')} AS mean, {s6('quantile_cont(v, 0.5e0)')} AS p50, {s6('quantile_cont(v, 0.99e0)')} AS p99, {s6('quantile_cont(v, 0.999e0)')} AS p999, {s6('quantile_cont(v, 0.99e0) FILTER (WHERE water)')} AS water_p99 FROM u GROUP BY 1",
)
def index_stats(spark, sf):
    s = screening.index_stats(view(spark, sf, "px"), ["fdi", "ndvi", "ndwi"])
    return s.select("index", *[r6(F.col(c)).alias(c) for c in ("mean", "p50", "p99", "p999", "water_p99")])


@query("fixed_vs_adaptive", f"WITH f AS (SELECT {_FDI} AS fdi, {_WATER} AND NOT {_CLOUD} AS clean FROM px), w AS (SELECT fdi FROM f WHERE clean AND fdi IS NOT NULL), t AS (SELECT greatest(0.006e0, quantile_cont(fdi, 0.999e0)) AS t FROM w) SELECT count(*) AS n, count(*) FILTER (WHERE fdi > 0.006e0) AS over_fixed, count(*) FILTER (WHERE fdi > t) AS over_adaptive, {s6('min(t)')} AS threshold FROM w, t")
def fixed_vs_adaptive(spark, sf):
    w = view(spark, sf, "px").withColumns({"fdi": spectral.INDICES["fdi"][1](), "clean": spectral.water_mask() & ~spectral.cloud_mask()}).filter("clean and fdi is not null")
    p = percentiles(w, "fdi", {"p": 0.999}).first()["p"]
    t = max(spectral.FDI_THRESHOLD, p if p is not None else spectral.FDI_THRESHOLD)
    return w.agg(F.count("*").alias("n"), F.count_if(F.col("fdi") > 0.006).alias("over_fixed"), F.count_if(F.col("fdi") > t).alias("over_adaptive"), r6(F.lit(t)).alias("threshold"))


_LONLAT = "c_custkey % 360 - 180 + 0.25e0 AS lon, c_custkey % 170 - 85 + 0.25e0 AS lat"


def _places(spark, sf):
    k = F.col("c_custkey")
    return _table(spark, sf, "customer").select("c_custkey", (k % 360 - 180 + 0.25).alias("lon"), (k % 170 - 85 + 0.25).alias("lat"))


@query("deg2num", f"WITH p AS (SELECT c_custkey, {_LONLAT} FROM customer) SELECT c_custkey, CAST(floor((lon + 180) / 360 * 4096) AS BIGINT) AS x, CAST(least(greatest(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096), 0), 4095) AS BIGINT) AS y FROM p")
def deg2num(spark, sf):
    return _places(spark, sf).select("c_custkey", geo.lon_tile(F.col("lon"), F.lit(12)).alias("x"), geo.lat_tile(F.col("lat"), F.lit(12)).alias("y"))


@query("tile_bounds", f"WITH t AS (SELECT p_partkey, p_partkey % 1024 AS x, p_partkey * 7 % 1024 AS y FROM part) SELECT p_partkey, {s6('x / 1024.0e0 * 360 - 180')} AS west, {s6('degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 1024.0e0))))')} AS south, {s6('(x + 1) / 1024.0e0 * 360 - 180')} AS east, {s6('degrees(atan(sinh(pi() * (1 - 2 * y / 1024.0e0))))')} AS north FROM t")
def tile_bounds(spark, sf):
    k = F.col("p_partkey")
    x, y, z = k % 1024, k * 7 % 1024, F.lit(10)
    out = {"west": geo.tile_lon(x, z), "south": geo.tile_lat(y + 1, z), "east": geo.tile_lon(x + 1, z), "north": geo.tile_lat(y, z)}
    return _table(spark, sf, "part").select("p_partkey", *[r6(e).alias(n) for n, e in out.items()])


@query("utm_zone", f"WITH p AS (SELECT c_custkey, {_LONLAT} FROM customer) SELECT c_custkey, CAST(least(greatest(floor((lon + 180) / 6) + 1, 1), 60) AS BIGINT) + CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END AS epsg FROM p")
def utm_zone(spark, sf):
    return _places(spark, sf).select("c_custkey", geo.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


def _utm_sql() -> str:
    """Easting and northing by the same series, in another engine's functions."""
    e = 2 * math.sqrt(geo._N) / (1 + geo._N)
    terms = list(enumerate(geo._ALPHA, 1))
    east = " + ".join(["eta", *(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in terms)])
    north = " + ".join(["xi", *(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in terms)])
    return f"""WITH p AS (SELECT c_custkey, {_LONLAT} FROM customer), q AS (SELECT *, CAST(least(greatest(floor((lon + 180) / 6) + 1, 1), 60) AS BIGINT) AS zone FROM p WHERE abs(lat) < 80),
a AS (SELECT *, radians(lon - (zone * 6 - 183)) AS lam, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) AS t FROM q),
x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM a)
SELECT c_custkey, zone, floor(({geo._FALSE_EAST!r} + {geo._K0 * geo._RADIUS!r} * ({east})) * 1e3 + 0.5e0) / 1e3 AS easting, floor({geo._K0 * geo._RADIUS!r} * ({north}) * 1e3 + 0.5e0) / 1e3 AS northing FROM x"""


@query("utm_forward", _utm_sql())
def utm_forward(spark, sf):
    p = _places(spark, sf).filter("abs(lat) < 80").withColumn("zone", geo.utm_zone(F.col("lon")))
    e, n = geo.utm_forward(F.col("lon"), F.col("lat"), F.col("zone"))
    return p.select("c_custkey", "zone", (F.floor(e * 1e3 + 0.5) / 1e3).alias("easting"), (F.floor(n * 1e3 + 0.5) / 1e3).alias("northing"))


@query("box_props", "SELECT det_id, (xmax - xmin) * (ymax - ymin) AS area, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy FROM dets")
def box_props(spark, sf):
    return view(spark, sf, "dets").select("det_id", geo.area().alias("area"), ((F.col("xmin") + F.col("xmax")) / 2).alias("cx"), ((F.col("ymin") + F.col("ymax")) / 2).alias("cy"))


@query("clip_boxes", "WITH o AS (SELECT det_id, xmin + 5 AS xmin, xmax + 5 AS xmax, ymin - 3 AS ymin, ymax - 3 AS ymax FROM dets), k AS (SELECT det_id, least(greatest(xmin, 0), 960) AS xmin, least(greatest(xmax, 0), 960) AS xmax, least(greatest(ymin, 0), 90) AS ymin, least(greatest(ymax, 0), 90) AS ymax FROM o) SELECT * FROM k WHERE xmax > xmin AND ymax > ymin AND (xmax - xmin) * (ymax - ymin) >= 1")
def clip_boxes(spark, sf):
    return detections.clip(detections.offset(view(spark, sf, "dets"), 5, -3), 960, 90).select("det_id", *detections.BOX)


_INTER = "greatest(least(d.xmax, g.xmax) - greatest(d.xmin, g.xmin), 0) * greatest(least(d.ymax, g.ymax) - greatest(d.ymin, g.ymin), 0)"
_IOU = f"{_INTER} / (128 - {_INTER})"  # all boxes of the views are 8 by 8
_PAIRS = f"SELECT d.det_id, g.gt_id, d.image, d.label, d.score, {_IOU} AS iou FROM dets d JOIN gts g ON d.image = g.image AND d.label = g.label AND abs(d.xmin - g.xmin) < 8 AND abs(d.ymin - g.ymin) < 8 WHERE {_IOU} >= 0.5"


@query("iou_pairs", f"WITH p AS ({_PAIRS}) SELECT det_id, gt_id, {s6('iou')} AS iou FROM p")
def iou_pairs(spark, sf):
    return detections.iou_pairs(view(spark, sf, "dets"), view(spark, sf, "gts")).select("det_id", "gt_id", r6(F.col("iou")).alias("iou"))


# In these views a box meets at most one box of the other side at this threshold, so the best pair per ground truth is the greedy match.
_MATCH = f"WITH p AS ({_PAIRS}), o AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY iou DESC, gt_id) AS k FROM p), m AS (SELECT det_id, gt_id, iou FROM (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY score DESC, det_id) AS n FROM o WHERE k = 1) WHERE n = 1)"


def _match(spark, sf, by_label=True):
    d, g = view(spark, sf, "dets"), view(spark, sf, "gts")
    return d, g, detections.match(d, g, 0.5, by_label)


@query("match_pairs", _MATCH + f" SELECT det_id, gt_id, {s6('iou')} AS iou FROM m")
def match_pairs(spark, sf):
    return _match(spark, sf)[2].select("det_id", "gt_id", r6(F.col("iou")).alias("iou"))


@query("unmatched_gts", _MATCH + " SELECT gt_id FROM gts WHERE gt_id NOT IN (SELECT gt_id FROM m)")
def unmatched_gts(spark, sf):
    _, g, m = _match(spark, sf)
    return g.join(m, "gt_id", "left_anti").select("gt_id")


_COUNTS = _MATCH + """, dd AS (SELECT label, count(*) AS n_det, count(m.det_id) AS tp FROM dets LEFT JOIN m USING (det_id) GROUP BY label), gg AS (SELECT label, count(*) AS n_gt FROM gts GROUP BY label),
k AS (SELECT label, coalesce(tp, 0) AS tp, coalesce(n_det, 0) - coalesce(tp, 0) AS fp, coalesce(n_gt, 0) - coalesce(tp, 0) AS fn FROM dd FULL JOIN gg USING (label))"""


@query("prf_per_class", _COUNTS + f" SELECT label, tp, fp, fn, {s6('tp / (tp + fp)')} AS p, {s6('tp / (tp + fn)')} AS r, {s6('2 * tp / (2 * tp + fp + fn)')} AS f1 FROM k")
def prf_per_class(spark, sf):
    c = F.col
    p, r, f1 = detections.prf(c("tp"), c("fp"), c("fn"))
    return detections.class_counts(*_match(spark, sf)).select("label", "tp", "fp", "fn", r6(p).alias("p"), r6(r).alias("r"), r6(f1).alias("f1"))


@query("rollup_metrics", _COUNTS + " SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM k GROUP BY ROLLUP (label)")
def rollup_metrics(spark, sf):
    return detections.class_counts(*_match(spark, sf)).rollup("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


_CURVE = _MATCH + """, h AS (SELECT label, det_id, score, CASE WHEN m.det_id IS NULL THEN 0 ELSE 1 END AS hit FROM dets LEFT JOIN m USING (det_id)),
w AS (SELECT label, det_id, row_number() OVER o AS rank, CAST(sum(hit) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp FROM h WINDOW o AS (PARTITION BY label ORDER BY score DESC, det_id)),
c AS (SELECT w.*, tp / n_gt AS recall, tp / rank AS precision FROM w JOIN (SELECT label, count(*) AS n_gt FROM gts GROUP BY label) USING (label)),
e AS (SELECT *, max(precision) OVER (PARTITION BY label ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM c)"""


@query("pr_curve", _CURVE + f" SELECT label, det_id, rank, tp, {s6('recall')} AS recall, {s6('precision')} AS precision, {s6('envelope')} AS envelope FROM e")
def pr_curve(spark, sf):
    return detections.pr_curve(*_match(spark, sf)).select("label", "det_id", "rank", "tp", *[r6(F.col(c)).alias(c) for c in ("recall", "precision", "envelope")])


_AP = _CURVE + ", s AS (SELECT *, recall - lag(recall, 1, 0) OVER (PARTITION BY label ORDER BY rank) AS step FROM e), ap AS (SELECT label, sum(step * envelope) AS ap FROM s GROUP BY label)"


@query("ap_all_points", _AP + f" SELECT label, {s6('ap')} AS ap FROM ap")
def ap_all_points(spark, sf):
    return detections.average_precision(detections.pr_curve(*_match(spark, sf))).select("label", r6(F.col("ap")).alias("ap"))


@query("map_50", _AP + f" SELECT {s6('avg(ap)')} AS map FROM ap")
def map_50(spark, sf):
    return detections.average_precision(detections.pr_curve(*_match(spark, sf))).agg(r6(F.avg("ap")).alias("map"))


@query("ap_101_point", _CURVE + f", l AS (SELECT label, k, max(envelope) AS p FROM e JOIN (SELECT unnest(range(101)) AS k) ON recall >= k * 0.01e0 GROUP BY label, k) SELECT label, {s6('sum(p) / 101')} AS ap FROM l GROUP BY label")
def ap_101_point(spark, sf):
    return detections.average_precision(detections.pr_curve(*_match(spark, sf)), "101").select("label", r6(F.col("ap")).alias("ap"))


@query("confusion_matrix", _MATCH.replace("AND d.label = g.label ", "") + " SELECT coalesce(g.label, 'background') AS truth, coalesce(d.label, 'background') AS predicted, count(*) AS n FROM (SELECT dets.label, m.gt_id FROM dets LEFT JOIN m USING (det_id)) d FULL JOIN gts g ON d.gt_id = g.gt_id GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return detections.confusion(*_match(spark, sf, False))


@query("nms_suppressed", """WITH d AS (SELECT det_id, CAST(floor(image / 10.0e0) AS bigint) AS image, label, score, xmin, ymin FROM dets),
p AS (SELECT a.det_id, b.det_id AS by_id FROM d a JOIN d b ON a.image = b.image AND a.label = b.label AND a.det_id <> b.det_id AND (b.score > a.score OR (b.score = a.score AND b.det_id < a.det_id))
  AND abs(a.xmin - b.xmin) < 8 AND abs(a.ymin - b.ymin) < 8 WHERE (8 - abs(a.xmin - b.xmin)) * (8 - abs(a.ymin - b.ymin)) / (128 - (8 - abs(a.xmin - b.xmin)) * (8 - abs(a.ymin - b.ymin))) > 0.8)
SELECT count(*) AS n_pairs, count(DISTINCT det_id) AS n_worse FROM p""")
def nms_suppressed(spark, sf):
    d = view(spark, sf, "dets").withColumn("image", F.floor(F.col("image") / 10))
    p = detections.iou_pairs(d, d.withColumnRenamed("det_id", "gt_id"), 1e-9, better=True).filter("iou > 0.8")
    return p.agg(F.count("*").alias("n_pairs"), F.count_distinct("det_id").alias("n_worse"))


# A box and another anywhere; suppression one box after the other, by falling score, as a recursive query.
_ANY_IOU = f"({_INTER}) / ((d.xmax - d.xmin) * (d.ymax - d.ymin) + (g.xmax - g.xmin) * (g.ymax - g.ymin) - {_INTER})"
#: In the view's tiles boxes that overlap by half start in the same square of 10 by 10.
_SQUARE = "image || ':' || floor(xmin / 10) || ':' || floor(ymin / 10)"


def nms_sql(boxes: str, same: str, threshold: float, part: str = "image", columns: str = "det_id, label, score") -> str:
    """Suppression among ``boxes``; the recursion runs within each ``part``, beyond which no two boxes may overlap so much."""
    return f"""WITH RECURSIVE b AS (SELECT *, {part} AS part FROM ({boxes})),
p AS (SELECT d.det_id, g.det_id AS by_id FROM b d JOIN b g ON d.image = g.image {same} AND (g.score > d.score OR (g.score = d.score AND g.det_id < d.det_id)) AND d.xmin < g.xmax AND g.xmin < d.xmax AND d.ymin < g.ymax AND g.ymin < d.ymax WHERE {_ANY_IOU} > {threshold}e0),
o AS (SELECT part, det_id, row_number() OVER (PARTITION BY part ORDER BY score DESC, det_id) AS k FROM b WHERE det_id IN (SELECT det_id FROM p)),
w AS (SELECT o.part, o.k, o.det_id, list(p.by_id) AS better FROM o JOIN p USING (det_id) GROUP BY ALL),
s AS (SELECT part, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone, CAST(NULL AS BIGINT) AS last FROM (SELECT DISTINCT part FROM w)
  UNION ALL SELECT s.part, w.k, CASE WHEN len(list_filter(better, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, w.det_id) ELSE gone END, CASE WHEN len(list_filter(better, lambda x: NOT list_contains(gone, x))) > 0 THEN w.det_id END FROM s JOIN w ON s.part = w.part AND w.k = s.k + 1)
SELECT {columns} FROM b WHERE det_id NOT IN (SELECT last FROM s WHERE last IS NOT NULL)"""


_TENS = "SELECT det_id, floor(image / 10e0) AS image, label, score, xmin, ymin, xmax, ymax FROM dets"


@query("nms_class_aware", nms_sql(_TENS, "AND d.label = g.label", 0.5, _SQUARE))
def nms_class_aware(spark, sf):
    return detections.nms(view(spark, sf, "dets").withColumn("image", F.floor(F.col("image") / 10)), 0.5).select("det_id", "label", "score")


@query("filter_detections", "SELECT det_id, label, score FROM dets WHERE score >= 0.5 AND label IN ('sargassum', 'marine_debris')")
def filter_detections(spark, sf):
    return view(spark, sf, "dets").filter((F.col("score") >= 0.5) & F.col("label").isin(list(detections.TARGETS))).select("det_id", "label", "score")


@query("top20_detections", "SELECT det_id, score FROM dets ORDER BY score DESC, det_id LIMIT 20")
def top20_detections(spark, sf):
    return view(spark, sf, "dets").orderBy(F.desc("score"), "det_id").limit(20).select("det_id", "score")


@query("scene_search", "SELECT o_orderkey AS scene_id, CAST(o_custkey % 100 AS DOUBLE) AS cloud FROM orders WHERE o_custkey % 360 - 180 <= 20 AND o_custkey % 360 - 179 >= -20 AND o_orderkey % 180 - 90 <= 30 AND o_orderkey % 180 - 89 >= -30 AND o_custkey % 100 < 50 ORDER BY 2, 1 LIMIT 100")
def scene_search(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = _table(spark, sf, "orders").select(k.alias("scene_id"), (c % 100).cast("double").alias("cloud"), (c % 360 - 180).alias("west"), (c % 360 - 179).alias("east"), (k % 180 - 90).alias("south"), (k % 180 - 89).alias("north"), F.lit("2024-01-01").alias("day"))
    return catalog.search(s, -20, -30, 20, 30, "2023-01-01", "2025-01-01", 50, 100).select("scene_id", "cloud")


_KEYS = "CASE l_linenumber % 4 WHEN 0 THEN 'red' WHEN 1 THEN ' B04' WHEN 2 THEN 'SCL' ELSE 'thumbnail' END"


@query("asset_first_wins", f"WITH k AS (SELECT l_orderkey, l_linenumber, {_KEYS} AS key FROM lineitem), b AS (SELECT *, CASE lower(trim(key)) WHEN 'red' THEN 'B04' WHEN 'b04' THEN 'B04' WHEN 'scl' THEN 'SCL' END AS band FROM k) SELECT l_orderkey, band, arg_min(key, l_linenumber) AS key FROM b WHERE band IS NOT NULL GROUP BY l_orderkey, band")
def asset_first_wins(spark, sf):
    k = _table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), F.expr(_KEYS).alias("key"))
    return catalog.normalize(k, ["l_orderkey"]).select("l_orderkey", "band", "key")


@query("provider_label", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'planetary-computer' WHEN 1 THEN 'earth-search' ELSE 'unknown' END AS provider FROM supplier")
def provider_label(spark, sf):
    url = F.element_at(F.array(F.lit("https://planetarycomputer.example/v1"), F.lit("https://earth-search.example/v1"), F.lit("https://stac.example")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return _table(spark, sf, "supplier").select("s_suppkey", catalog.provider(url).alias("provider"))


@query("roi_decode", "SELECT p_partkey, CAST(make_date(2000 + CAST(p_partkey % 25 AS INT), CAST(p_partkey % 12 + 1 AS INT), CAST(p_partkey % 28 + 1 AS INT)) AS VARCHAR) AS day, 'T' || (p_partkey % 60) AS tile FROM part")
def roi_decode(spark, sf):
    k = F.col("p_partkey")
    roi = F.concat(k % 28 + 1, F.lit("-"), k % 12 + 1, F.lit("-"), k % 25, F.lit("_T"), k % 60, F.lit("_0"))
    return _table(spark, sf, "part").select("p_partkey", catalog.roi_date(roi).cast("string").alias("day"), F.split_part(roi, F.lit("_"), F.lit(2)).alias("tile"))


@query("prompt_match", "SELECT p_partkey, CASE WHEN p_type LIKE '%BRASS%' THEN 'ship' WHEN p_type LIKE '%TIN%' THEN 'foam' ELSE 'unknown' END AS label FROM part")
def prompt_match(spark, sf):
    return _table(spark, sf, "part").select("p_partkey", catalog.prompt_class(F.col("p_type"), [("tin", "foam"), ("brass", "ship")]).alias("label"))


# A score below a thousandth reads as 4.8E-4 there.
_SCORE = "CASE WHEN score6 >= 1000 OR score6 = 0 THEN CAST(score6 / 1e6 AS VARCHAR) WHEN score6 >= 100 THEN CAST(score6 / 1e2 AS VARCHAR) || 'E-4' WHEN score6 >= 10 THEN CAST(score6 / 1e1 AS VARCHAR) || 'E-5' ELSE CAST(score6 / 1e0 AS VARCHAR) || 'E-6' END"


@query("geojson_features", f"""WITH f AS (SELECT *, round(score * 1e6) AS score6 FROM dets)
SELECT det_id, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[' || xmin || ',' || ymin || '],[' || xmax || ',' || ymin || '],[' || xmax || ',' || ymax || '],[' || xmin || ',' || ymax || '],[' || xmin || ',' || ymin || ']]]}},"properties":{{"label":"' || label || '","score":' || {_SCORE} || '}}}}' AS feature FROM f""")
def geojson_features(spark, sf):
    return features(view(spark, sf, "dets"))


@query("geojson_roundtrip", "SELECT label, count(*) AS n, sum(xmin) AS sx, sum(ymax) AS sy FROM dets GROUP BY label")
def geojson_roundtrip(spark, sf):
    f = features(view(spark, sf, "dets")).select(F.from_json("feature", FEATURES.split("array<", 1)[1][:-1]).alias("f"))
    return from_features(f).groupBy("label").agg(F.count("*").alias("n"), F.sum("xmin").alias("sx"), F.sum("ymax").alias("sy"))


_SPECTRA = "SELECT vec_id, label AS truth, embedding[1] + embedding[2] AS s, CASE WHEN embedding[1] > 0 THEN label ELSE 9 - label END AS pred FROM embeddings"


def _spectra(spark, sf):
    e = lambda i: F.element_at("embedding", i)
    return _table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("truth"), F.when(e(1) > 0, F.col("label")).otherwise(9 - F.col("label")).alias("pred"))


@query("class_report", f"WITH x AS ({_SPECTRA}), k AS (SELECT truth, pred, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT truth AS label, sum(n) AS support, sum(n) FILTER (WHERE truth = pred) AS tp FROM k GROUP BY truth), p AS (SELECT pred AS label, sum(n) AS n_pred FROM k GROUP BY pred) SELECT label, CAST(support AS BIGINT) AS support, {s6('CASE WHEN n_pred > 0 THEN coalesce(tp, 0) / n_pred ELSE 0 END')} AS precision, {s6('coalesce(tp, 0) / support')} AS recall FROM t LEFT JOIN p USING (label)")
def class_report(spark, sf):
    k = _spectra(spark, sf).groupBy("truth", "pred").agg(F.count("*").alias("n"))
    return curves.class_report(k).select("label", "support", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


@query("export_min_score", "SELECT label, count(*) AS n FROM dets WHERE coalesce(score, 0) >= 0.25 GROUP BY label")
def export_min_score(spark, sf):
    return view(spark, sf, "dets").filter(F.coalesce("score", F.lit(0.0)) >= 0.25).groupBy("label").agg(F.count("*").alias("n"))


@query("asset_last_wins", f"WITH k AS (SELECT l_orderkey, l_linenumber, {_KEYS} AS key FROM lineitem), b AS (SELECT *, CASE lower(trim(key)) WHEN 'red' THEN 'B04' WHEN 'b04' THEN 'B04' WHEN 'scl' THEN 'SCL' END AS band FROM k) SELECT l_orderkey, band, arg_max(key, l_linenumber) AS key FROM b WHERE band IS NOT NULL GROUP BY l_orderkey, band")
def asset_last_wins(spark, sf):
    k = _table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), F.expr(_KEYS).alias("key"))
    return catalog.normalize(k, ["l_orderkey"], first=False).select("l_orderkey", "band", "key")


_SWEEP = _PAIRS.replace(">= 0.5", ">= t.thr").replace("d.det_id,", "t.thr, d.det_id,", 1).replace(" WHERE", " CROSS JOIN (SELECT unnest([0.5e0, 0.55e0, 0.6e0, 0.65e0, 0.7e0, 0.75e0, 0.8e0, 0.85e0, 0.9e0, 0.95e0]) AS thr) t WHERE", 1)


@query("sweep_matches", f"WITH p AS ({_SWEEP}) SELECT thr AS threshold, count(DISTINCT gt_id) AS n FROM p GROUP BY thr")
def sweep_matches(spark, sf):
    """Matches at ten IoU thresholds; the pairs are made once."""
    p = detections.iou_pairs(view(spark, sf, "dets"), view(spark, sf, "gts"))
    levels = F.explode(F.array(*[F.lit(round(0.5 + 0.05 * i, 2)) for i in range(10)]))
    return p.withColumn("threshold", levels).filter("iou >= threshold").groupBy("threshold").agg(F.count_distinct("gt_id").alias("n"))


@query("best_f1", f"""WITH x AS (SELECT vec_id, label = 3 AS pos, embedding[1] AS s FROM embeddings), c AS (SELECT vec_id, s, sum(CASE WHEN pos THEN 1 ELSE 0 END) OVER (ORDER BY s DESC, vec_id ROWS UNBOUNDED PRECEDING) AS tp, row_number() OVER (ORDER BY s DESC, vec_id) AS n FROM x),
f AS (SELECT n, 2 * tp / (n + (SELECT count(*) FROM x WHERE pos)) AS f1 FROM c) SELECT {s6('max(f1)')} AS f1 FROM f""")
def best_f1(spark, sf):
    x = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") == 3).cast("long").alias("pos"), F.element_at("embedding", 1).alias("score"))
    return curves.running(x).agg(r6(curves.best_f1()).alias("f1"))


_FEATURE_SQL = {"B03": "green", "B04": "red", "B06": "rededge2", "B08": "nir", "B11": "swir1", "FDI": INDEX_SQL["fdi"], "FAI": INDEX_SQL["fai"], "NDVI": INDEX_SQL["ndvi"], "NDWI": INDEX_SQL["ndwi"], "PI": INDEX_SQL["pi"], "KNDVI": INDEX_SQL["kndvi"], "MNDWI": INDEX_SQL["mndwi"]}


@query("features_18", "SELECT pid, " + ", ".join(f"{s6(_FEATURE_SQL[f])} AS {f}" if f in _FEATURE_SQL else f"CAST(NULL AS DOUBLE) AS {f}" for f in spectral.FEATURES) + " FROM px")
def features_18(spark, sf):
    return spectral.features(view(spark, sf, "px"), {"B03": "green", "B04": "red", "B06": "rededge2", "B08": "nir", "B11": "swir1"}).select("pid", *[r6(F.col(f)).alias(f) for f in spectral.FEATURES])


def _bright_tiles(parts):
    """A detector to test with: a box around each tile."""
    for t in parts:
        yield t.assign(label="marine_debris", score=0.5)[["tr", "tc", "label", "score"]]


@query("detect_pipeline", _VERDICTS.replace("0.95e0", "0.6e0") + "SELECT tr, tc, 'marine_debris' AS label, 0.5e0 AS score FROM v WHERE n_regions > 0")
def detect_pipeline(spark, sf):
    """Screening first, the detector on what it accepts alone."""
    return screening.detect(screening.screen(view(spark, sf, "px"), 0.6).select("tr", "tc", "accepted"), _bright_tiles, "tr long, tc long, label string, score double")
