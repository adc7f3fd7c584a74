"""More registered queries: regridding, evaluation, coast, classes, catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from seasight.functions import geo, spectral
from seasight.operators import boosting, catalog, classifier, curves, detections
from seasight.plans.queries import _AP, _CLOUD, _COUNTS, _FDI, _MATCH, _SPECTRA, _SQUARE, _SWEEP, _TENS, _WATER, _match, _places, _spectra, _table, nms_sql, query, r6, s6
from seasight.operators.quantiles import percentiles
from seasight.sources.reports import markdown_rows
from seasight.views import view

c = F.col


@query("match_counts", _MATCH + " SELECT image, count(*) AS n_pred, count(m.det_id) AS tp, count(*) - count(m.det_id) AS fp FROM dets LEFT JOIN m USING (det_id) GROUP BY image")
def match_counts(spark, sf):
    d, _, m = _match(spark, sf)
    hit = d.join(m.select("det_id", F.lit(1).alias("hit")), "det_id", "left")
    return hit.groupBy("image").agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp"), (F.count("*") - F.count("hit")).alias("fp"))


@query("prf_micro", _COUNTS + f", z AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM k) SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {s6('tp / (tp + fp)')} AS p, {s6('tp / (tp + fn)')} AS r, {s6('2 * tp / (2 * tp + fp + fn)')} AS f1 FROM z")
def prf_micro(spark, sf):
    z = detections.class_counts(*_match(spark, sf)).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    p, r, f1 = detections.prf(c("tp"), c("fp"), c("fn"))
    return z.select("tp", "fp", "fn", r6(p).alias("p"), r6(r).alias("r"), r6(f1).alias("f1"))


_AP_SWEEP = f"""WITH t AS (SELECT unnest([0.5e0, 0.55e0, 0.6e0, 0.65e0, 0.7e0, 0.75e0, 0.8e0, 0.85e0, 0.9e0, 0.95e0]) AS thr), p AS ({_SWEEP}),
m AS (SELECT thr, det_id FROM (SELECT thr, det_id, row_number() OVER (PARTITION BY thr, gt_id ORDER BY score DESC, det_id) AS n FROM p) WHERE n = 1),
h AS (SELECT d.thr, label, d.det_id, score, CASE WHEN m.det_id IS NULL THEN 0 ELSE 1 END AS hit FROM (SELECT * FROM dets CROSS JOIN t) d LEFT JOIN m ON d.thr = m.thr AND d.det_id = m.det_id),
w AS (SELECT thr, label, hit, row_number() OVER o AS rank, sum(hit) OVER (o ROWS UNBOUNDED PRECEDING) AS tp FROM h WINDOW o AS (PARTITION BY thr, label ORDER BY score DESC, det_id)),
e AS (SELECT *, max(tp / rank) OVER (PARTITION BY thr, label ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM w),
a AS (SELECT thr, label, sum(hit * envelope) / any_value(n_gt) AS ap FROM e JOIN (SELECT label, count(*) AS n_gt FROM gts GROUP BY label) USING (label) GROUP BY thr, label)"""


@query("ap_sweep", _AP_SWEEP + f" SELECT thr AS threshold, label, {s6('ap')} AS ap FROM a")
def ap_sweep(spark, sf):
    return detections.sweep(view(spark, sf, "dets"), view(spark, sf, "gts")).select("threshold", "label", r6(c("ap")).alias("ap"))


@query("map_50_95", _AP_SWEEP + f" SELECT {s6('avg(ap)')} AS map FROM a")
def map_50_95(spark, sf):
    return detections.sweep(view(spark, sf, "dets"), view(spark, sf, "gts")).agg(r6(F.avg("ap")).alias("map"))


_KINDS = ("background", "marine_debris", "sargassum", "ship")


@query("confusion_pivot", _MATCH.replace("AND d.label = g.label ", "") + ", x AS (SELECT coalesce(g.label, 'background') AS truth, coalesce(d.label, 'background') AS predicted FROM (SELECT dets.label, m.gt_id FROM dets LEFT JOIN m USING (det_id)) d FULL JOIN gts g ON d.gt_id = g.gt_id) SELECT truth, " + ", ".join(f"count(*) FILTER (WHERE predicted = '{k}') AS {k}" for k in _KINDS) + " FROM x GROUP BY truth")
def confusion_pivot(spark, sf):
    return detections.confusion(*_match(spark, sf, False)).groupBy("truth").pivot("predicted", list(_KINDS)).agg(F.sum("n")).na.fill(0)


_TWO = lambda e: f"printf('%.2f', floor(({e}) * 100 + 0.5e0) / 100)"


@query("evaluation_report", _COUNTS + _AP[len(_MATCH) :] + f""", z AS (SELECT label, tp, fp, fn, ap FROM k LEFT JOIN ap USING (label) UNION ALL SELECT 'all', sum(tp), sum(fp), sum(fn), (SELECT avg(ap) FROM ap) FROM k)
SELECT label, '| ' || concat_ws(' | ', label, CAST(tp AS BIGINT), CAST(fp AS BIGINT), CAST(fn AS BIGINT), {_TWO('tp / (tp + fp)')}, {_TWO('tp / (tp + fn)')}, {_TWO('2 * tp / (2 * tp + fp + fn)')}, {_TWO('ap')}) || ' |' AS line FROM z""")
def evaluation_report(spark, sf):
    return markdown_rows(detections.evaluate(view(spark, sf, "dets"), view(spark, sf, "gts"))).select("label", "line")


@query("nms_agnostic", nms_sql(_TENS, "", 0.5, _SQUARE))
def nms_agnostic(spark, sf):
    return detections.nms(view(spark, sf, "dets").withColumn("image", F.floor(c("image") / 10)), 0.5, ("image",)).select("det_id", "label", "score")


_TILES = """SELECT det_id, image, label, score, xmin, ymin, least(xmax, 1875) AS xmax, least(ymax, 95) AS ymax
FROM (SELECT det_id, floor(image / 2e0) AS image, label, score, xmin + image % 2 * 880 AS xmin, ymin, xmax + image % 2 * 880 AS xmax, ymax FROM dets)
WHERE xmin < 1875 AND ymin < 95 AND (least(xmax, 1875) - xmin) * (least(ymax, 95) - ymin) >= 1"""


@query("merge_tiles", nms_sql(_TILES, "AND d.label = g.label", 0.3, _SQUARE, "det_id, xmin, ymin, xmax, ymax"))
def merge_tiles(spark, sf):
    """Tiles that share 122 columns, in which boxes of one label meet; the scene cuts boxes at two of its sides."""
    d = view(spark, sf, "dets").withColumns({"x_off": (c("image") % 2) * 880.0, "y_off": F.lit(0.0), "image": F.floor(c("image") / 2)})
    return detections.merge_tiles(d, 1875, 95, 0.3).select("det_id", *detections.BOX)


@query("utm_inverse", f"SELECT c_custkey, {s6('c_custkey % 360 - 180 + 0.25e0')} AS lon, {s6('c_custkey % 170 - 85 + 0.25e0')} AS lat FROM customer WHERE abs(c_custkey % 170 - 85 + 0.25e0) < 80")
def utm_inverse(spark, sf):
    """There and back again."""
    p = _places(spark, sf).filter("abs(lat) < 80").withColumn("zone", geo.utm_zone(c("lon")))
    e, n = geo.utm_forward(c("lon"), c("lat"), c("zone"))
    lon, lat = geo.utm_inverse(c("e"), c("n"), c("zone"))
    return p.withColumns({"e": e, "n": n}).select("c_custkey", r6(lon).alias("lon"), r6(lat).alias("lat"))


@query("pixel_to_map", "SELECT det_id, 300000 + xmin * 10 AS x0, 4000000 - ymin * 10 AS y0, 300000 + xmax * 10 AS x1, 4000000 - ymax * 10 AS y1 FROM dets")
def pixel_to_map(spark, sf):
    at = lambda a, b: geo.affine(c(a), c(b), (10.0, 0.0, 300000.0, 0.0, -10.0, 4000000.0))
    (x0, y0), (x1, y1) = at("xmin", "ymin"), at("xmax", "ymax")
    return view(spark, sf, "dets").select("det_id", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


_CLASS_SQL = "CASE p_partkey % 17 " + " ".join(f"WHEN {i} THEN '{s}'" for i, (_, s) in enumerate(catalog.CLASSES, 1)) + " ELSE 'unknown' END"


@query("label_map", f"SELECT p_partkey, {_CLASS_SQL} AS label FROM part")
def label_map(spark, sf):
    return _table(spark, sf, "part").select("p_partkey", catalog.surface_class(catalog.class_name(c("p_partkey") % 17)).alias("label"))


@query("multi_hot_decode", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 2 = 1 THEN 'marine_debris' END, CASE WHEN (p_size // 2) % 4 > 0 THEN 'sargassum' END, CASE WHEN (p_size // 8) % 4 = 1 OR (p_size // 8) % 4 = 3 THEN 'sargassum' END], lambda x: x IS NOT NULL)[1:2], ',') AS labels FROM (SELECT p_partkey, p_size % 8 AS p_size FROM part)")
def multi_hot_decode(spark, sf):
    bits = F.array(*[F.shiftright(c("p_size") % 8, i).bitwiseAND(F.lit(1)) for i in range(3)])
    return _table(spark, sf, "part").select("p_partkey", F.array_join(catalog.multi_hot(bits), ",").alias("labels"))


@query("band_gsd", "WITH k AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'nir08' ELSE 'coastal' END AS key FROM lineitem) SELECT l_orderkey, l_linenumber, CASE key WHEN 'red' THEN 10 WHEN 'nir08' THEN 20 ELSE 60 END AS gsd FROM k")
def band_gsd(spark, sf):
    key = F.element_at(F.array(F.lit("red"), F.lit("nir08"), F.lit("coastal")), (c("l_linenumber") % 3 + 1).cast("int"))
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", catalog.gsd(catalog.alias(key)).alias("gsd"))


@query("tile_url", "SELECT p_partkey, 'https://tiles.example/data/v1/PSScene/' || p_brand || '/10/' || (p_partkey % 1024) || '/' || (p_partkey * 7 % 1024) || '.png' AS url FROM part")
def tile_url(spark, sf):
    k = c("p_partkey")
    return _table(spark, sf, "part").select("p_partkey", catalog.tile_url("https://tiles.example/data/v1/", F.lit("PSScene"), c("p_brand"), F.lit(10), k % 1024, k * 7 % 1024).alias("url"))


@query("valid_boxes", "SELECT o_orderkey FROM orders WHERE o_custkey % 400 - 200 BETWEEN -180 AND 180 AND o_orderkey % 200 - 100 BETWEEN -90 AND 90 AND o_orderkey % 190 - 90 BETWEEN -90 AND 90 AND o_orderkey % 190 - 90 >= o_orderkey % 200 - 100")
def valid_boxes(spark, sf):
    k, lon = c("o_orderkey"), c("o_custkey") % 400 - 200
    b = _table(spark, sf, "orders").select("o_orderkey", lon.alias("west"), lon.alias("east"), (k % 200 - 100).alias("south"), (k % 190 - 90).alias("north"))
    return b.filter(catalog.valid_box()).select("o_orderkey")


_PROBA = "abs(CAST(embedding[{}] AS DOUBLE))"


@query("binary_any_of", f"SELECT vec_id, {s6('(' + _PROBA.format(4) + ' + ' + _PROBA.format(5) + ')')} AS score FROM embeddings")
def binary_any_of(spark, sf):
    e = _table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 10), lambda x: F.abs(x.cast("double"))).alias("proba"))
    return e.select("vec_id", r6(curves.any_of(c("proba"), [3, 4])).alias("score"))


@query("recall_at_p20", f"""WITH x AS (SELECT vec_id, label IN (3, 4) AS pos, embedding[1] AS s FROM embeddings), k AS (SELECT sum(CASE WHEN pos THEN 1 ELSE 0 END) OVER o AS tp, row_number() OVER (ORDER BY s DESC, vec_id) AS n FROM x WINDOW o AS (ORDER BY s DESC, vec_id ROWS UNBOUNDED PRECEDING))
SELECT {s6('max(tp / (SELECT count(*) FROM x WHERE pos)) FILTER (WHERE tp >= 0.2e0 * n)')} AS recall FROM k""")
def recall_at_p20(spark, sf):
    x = _table(spark, sf, "embeddings").select(c("vec_id").alias("id"), c("label").isin(3, 4).cast("long").alias("pos"), F.element_at("embedding", 1).alias("score"))
    return curves.running(x).agg(r6(curves.recall_at(0.2)).alias("recall"))


@query("missed_as", f"WITH x AS ({_SPECTRA}) SELECT pred, count(*) AS n FROM x WHERE truth IN (3, 4) AND pred NOT IN (3, 4) GROUP BY pred")
def missed_as(spark, sf):
    return _spectra(spark, sf).filter(c("truth").isin(3, 4) & ~c("pred").isin(3, 4)).groupBy("pred").agg(F.count("*").alias("n"))


@query("false_alarms_from", f"WITH x AS ({_SPECTRA}) SELECT truth, count(*) AS n FROM x WHERE pred IN (3, 4) AND truth NOT IN (3, 4) GROUP BY truth")
def false_alarms_from(spark, sf):
    return _spectra(spark, sf).filter(c("pred").isin(3, 4) & ~c("truth").isin(3, 4)).groupBy("truth").agg(F.count("*").alias("n"))


@query("forest_predict")
def forest_predict(spark, sf):
    """No SQL: the tests hold its held-out accuracy. Learns from two thirds of the rows, predicts all."""
    names = [f"f{i}" for i in range(64)]
    e = _table(spark, sf, "embeddings").filter("embedding is not null").select("vec_id", "label", *[F.get("embedding", i).alias(n) for i, n in enumerate(names)])
    model = classifier.fit(e.filter("vec_id % 3 <> 1"), names, trees=20, depth=8)
    return classifier.predict(model, e).select("vec_id", "label", "predicted")


@query("boosted_predict")
def boosted_predict(spark, sf):
    """No SQL: the tests hold the trees against a recursion. Learns from two thirds of the rows, predicts all."""
    names = [f"f{i}" for i in range(64)]
    e = _table(spark, sf, "embeddings").filter("embedding is not null").select("vec_id", "label", *[F.get("embedding", i).alias(n) for i, n in enumerate(names)])
    model = boosting.fit(e.filter("vec_id % 3 <> 1"), names, rounds=8, rate=0.3, depth=3, bins=32)
    return boosting.predict(model, e).select("vec_id", "label", "predicted")
