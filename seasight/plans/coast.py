"""Registered queries of the coast: segments, zones, fronts, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from seasight.operators import coastal
from seasight.plans.queries import query, r6, s6
from seasight.views import view

c = F.col
TARGETS = "label IN ('sargassum', 'marine_debris')"


def _to_edge(x: str, y: str) -> str:
    """SQL of the distance from a point to the edge (x0, y0)-(x1, y1)."""
    size = "((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"
    t = f"(CASE WHEN {size} > 0 THEN least(greatest((({x}) - x0) * (x1 - x0) + (({y}) - y0) * (y1 - y0), 0e0) / {size}, 1) ELSE 0 END)"
    return f"sqrt(pow(({x}) - (x0 + {t} * (x1 - x0)), 2) + pow(({y}) - (y0 + {t} * (y1 - y0)), 2))"


def _to_box(x: str, y: str) -> str:
    return f"sqrt(pow(greatest(xmin - ({x}), ({x}) - xmax, 0), 2) + pow(greatest(ymin - ({y}), ({y}) - ymax, 0), 2))"


def _crosses() -> str:
    """SQL: the edge crosses one of the box's sides."""
    out = []
    for a, b, lo, hi, u, v in (("x0", "x1", "ymin", "ymax", "y0", "y1"), ("y0", "y1", "xmin", "xmax", "x0", "x1")):
        for side in ("xmin", "xmax") if a == "x0" else ("ymin", "ymax"):
            out.append(f"({a} <> {b} AND ({side} - {a}) / ({b} - {a}) BETWEEN 0 AND 1 AND {u} + ({side} - {a}) / ({b} - {a}) * ({v} - {u}) BETWEEN {lo} AND {hi})")
    return " OR ".join(out)


_BOX_EDGE = f"CASE WHEN {_crosses()} THEN 0 ELSE least({_to_box('x0', 'y0')}, {_to_box('x1', 'y1')}, {', '.join(_to_edge(x, y) for x in ('xmin', 'xmax') for y in ('ymin', 'ymax'))}) END"
_PAIRS = "drift JOIN shore USING (image)"


def _most(way: int) -> str:
    """SQL: of the zone of an edge at x, the edge's place under its highest (1) or lowest point."""
    return f"least(greatest(CASE WHEN x1 <> x0 THEN (x - {way} * lean - x0) / (x1 - x0) ELSE {way} * sign(y1 - y0) END, 0e0), 1e0)"


def _mean(way: int, t: str) -> str:
    """SQL: the mean height of that border between a and z: of an arc about an end of the edge, or of a side, which it has at x."""
    under = lambda v: f"(least(greatest({v}, -20), 20) * sqrt(greatest(400 - pow({v}, 2), 0)) + 400 * asin(least(greatest({v}, -20), 20) / 20)) / 2"
    at = f"(x0 + {t} * (x1 - x0))"
    return f"y0 + {t} * (y1 - y0) + {way} * CASE WHEN {t} IN (0, 1) THEN ({under(f'(z - {at})')} - {under(f'(a - {at})')}) / (z - a) ELSE sqrt(greatest(400 - pow(x - {at}, 2), 0)) END"


#: ar: per segment the area that boxes cover of its zone (kind 0), and that of the zone (kind 1): mean heights between neighbours among all x where a circle or a side begins, ends or meets another.
_AREAS = f"""e AS (SELECT DISTINCT seg_id, image, x0, y0, x1, y1, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS len FROM shore),
b AS (SELECT DISTINCT 0 AS kind, seg_id, xmin, ymin, xmax, ymax FROM drift JOIN e USING (image)
    WHERE {TARGETS} AND xmin <= greatest(x0, x1) + 20 AND xmax >= least(x0, x1) - 20 AND ymin <= greatest(y0, y1) + 20 AND ymax >= least(y0, y1) - 20
  UNION ALL SELECT 1, seg_id, min(least(x0, x1)) - 20, -1e9, max(greatest(x0, x1)) + 20, 1e9 FROM e GROUP BY seg_id),
kk AS (SELECT DISTINCT kind, seg_id FROM b),
n AS (SELECT kind, e.*, -20 * (y1 - y0) / len AS nx, 20 * (x1 - x0) / len AS ny FROM e JOIN kk USING (seg_id) WHERE len > 0),
ci AS (SELECT kind, seg_id, x0 AS cx, y0 AS cy FROM e JOIN kk USING (seg_id) UNION SELECT kind, seg_id, x1, y1 FROM e JOIN kk USING (seg_id)),
ln AS (SELECT kind, seg_id, x0 + nx AS qx, y0 + ny AS qy, (x1 - x0) / len AS ux, (y1 - y0) / len AS uy FROM n UNION SELECT kind, seg_id, x0 - nx, y0 - ny, (x1 - x0) / len, (y1 - y0) / len FROM n
  UNION SELECT kind, seg_id, 0, ymin, 1, 0 FROM b WHERE kind = 0 UNION SELECT kind, seg_id, 0, ymax, 1, 0 FROM b WHERE kind = 0),
cc AS (SELECT p.kind, p.seg_id, (p.cx + q.cx) / 2 AS mx, q.cy - p.cy AS dy, sqrt(pow(q.cx - p.cx, 2) + pow(q.cy - p.cy, 2)) AS d FROM ci p JOIN ci q ON p.kind = q.kind AND p.seg_id = q.seg_id),
cl AS (SELECT kind, seg_id, qx + ux * (ux * (cx - qx) + uy * (cy - qy)) AS fx, ux, ux * (cy - qy) - uy * (cx - qx) AS s FROM ci JOIN ln USING (kind, seg_id)),
ll AS (SELECT p.kind, p.seg_id, p.qx, p.ux, (q.qx - p.qx) * q.uy - (q.qy - p.qy) * q.ux AS t, p.ux * q.uy - p.uy * q.ux AS det FROM ln p JOIN ln q ON p.kind = q.kind AND p.seg_id = q.seg_id),
xs AS (SELECT kind, seg_id, xmin AS x FROM b UNION SELECT kind, seg_id, xmax FROM b UNION SELECT kind, seg_id, cx - 20 FROM ci UNION SELECT kind, seg_id, cx + 20 FROM ci
  UNION SELECT kind, seg_id, x0 + nx FROM n UNION SELECT kind, seg_id, x0 - nx FROM n UNION SELECT kind, seg_id, x1 + nx FROM n UNION SELECT kind, seg_id, x1 - nx FROM n
  UNION SELECT kind, seg_id, mx - sqrt(400 - d * d / 4) * dy / d FROM cc WHERE d > 0 AND d <= 40 UNION SELECT kind, seg_id, fx - sqrt(400 - s * s) * ux FROM cl WHERE abs(s) <= 20
  UNION SELECT kind, seg_id, fx + sqrt(400 - s * s) * ux FROM cl WHERE abs(s) <= 20 UNION SELECT kind, seg_id, qx + ux * t / det FROM ll WHERE abs(det) > 1e-12),
iv AS (SELECT kind, seg_id, x AS a, lead(x) OVER (PARTITION BY kind, seg_id ORDER BY x) AS z FROM xs JOIN (SELECT seg_id, min(xmin) AS lo, max(xmax) AS hi FROM b WHERE kind = 1 GROUP BY seg_id) USING (seg_id) WHERE x BETWEEN lo AND hi),
nd AS MATERIALIZED (SELECT kind, seg_id, a, z, (a + z) / 2 AS x FROM iv WHERE z - a > 1e-12),
hh AS (SELECT kind, seg_id, a, z, x, x0, y0, x1, y1, {_most(1)} AS up, {_most(-1)} AS down
  FROM nd JOIN (SELECT *, CASE WHEN len > 0 THEN -20 * (y1 - y0) * sign(x1 - x0) / len ELSE 0 END AS lean FROM e) USING (seg_id) WHERE x BETWEEN least(x0, x1) - 20 AND greatest(x0, x1) + 20),
hw AS (SELECT *, 400 - pow(x - x0 - up * (x1 - x0), 2) AS ru, 400 - pow(x - x0 - down * (x1 - x0), 2) AS rd FROM hh),
iu AS (SELECT kind, seg_id, a, z, x, greatest({_mean(-1, "down")}, ymin) AS lo, least({_mean(1, "up")}, ymax) AS hi
  FROM hw JOIN b USING (kind, seg_id) WHERE x BETWEEN xmin AND xmax AND ru >= 0 AND rd >= 0),
mm AS (SELECT *, max(hi) OVER (PARTITION BY kind, seg_id, x ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM iu WHERE hi > lo),
ar AS (SELECT kind, seg_id, sum(greatest(hi - greatest(lo, coalesce(upto, lo)), 0) * (z - a)) AS area FROM mm GROUP BY kind, seg_id),
u AS (SELECT seg_id, area FROM ar WHERE kind = 0 AND area > 0), z AS (SELECT seg_id, area AS zone_area FROM ar WHERE kind = 1)"""


def _roots() -> str:
    """SQL: shares of the edge at which it meets the lines and circles 20 from a box, and its ends."""
    out = ["0e0", "1e0"] + [f"({k} {s} 20 - {a}0) / nullif({a}1 - {a}0, 0)" for a in "xy" for k, s in ((f"{a}min", "-"), (f"{a}max", "+"))]
    for x in ("xmin", "xmax"):
        for y in ("ymin", "ymax"):
            along = f"((x1 - x0) * (x0 - {x}) + (y1 - y0) * (y0 - {y}))"
            root = f"sqrt(greatest({along} * {along} - size * (pow(x0 - {x}, 2) + pow(y0 - {y}, 2) - 400), 0))"
            out += [f"(-{along} - {root}) / size", f"(-{along} + {root}) / size"]
    return f"[{', '.join(out)}]"


#: The distance to a box is convex along an edge: those of these places that are near enough span all that are.
_FRONT = f"""l AS (SELECT DISTINCT seg_id, image, x0, y0, x1, y1, pow(x1 - x0, 2) + pow(y1 - y0, 2) AS size FROM shore WHERE x0 <> x1 OR y0 <> y1),
k AS (SELECT l.*, det_id, xmin, ymin, xmax, ymax, unnest({_roots()}) AS t FROM l JOIN drift USING (image) WHERE {TARGETS}),
p AS (SELECT *, x0 + t * (x1 - x0) AS x, y0 + t * (y1 - y0) AS y FROM k WHERE t BETWEEN 0 AND 1),
q AS (SELECT seg_id, x0, y0, x1, y1, size, det_id, min(t) AS t0, max(t) AS t1 FROM p WHERE {_to_box('x', 'y')} <= 20 + 1e-9 GROUP BY ALL),
v AS (SELECT *, max(t1) OVER (PARTITION BY seg_id, x0, y0, x1, y1 ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM q),
f AS (SELECT seg_id, sum(greatest(t1 - greatest(t0, coalesce(upto, t0)), 0) * sqrt(size)) AS front FROM v GROUP BY seg_id HAVING max(t1 - t0) > 0)"""
_NEAR = f"h AS (SELECT seg_id, count(DISTINCT det_id) AS n_detections FROM {_PAIRS} WHERE {TARGETS} AND {_BOX_EDGE} <= 20 GROUP BY seg_id)"
_ROLL = f"""WITH {_AREAS}, {_FRONT}, {_NEAR}, s AS (SELECT seg_id, min(name) AS name, sum(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2))) AS front_length FROM shore GROUP BY seg_id),
r AS (SELECT seg_id, name, CASE WHEN coalesce(cloud_fraction, 0) > 0.7 THEN 'blind' WHEN coalesce(cloud_fraction, 0) > 0.2 THEN 'partial' ELSE 'observed' END AS state, coalesce(cloud_fraction, 0e0) AS cloud_fraction,
  coalesce(area, 0) / zone_area AS coverage, coalesce(area, 0) AS area, coalesce(front, 0) AS front, front_length, coalesce(front, 0) / front_length AS front_fraction, coalesce(n_detections, 0) AS n_detections
  FROM s JOIN z USING (seg_id) LEFT JOIN u USING (seg_id) LEFT JOIN f USING (seg_id) LEFT JOIN h USING (seg_id) LEFT JOIN clouds USING (seg_id))
"""
_NUMBERS = ("area", "coverage", "front", "front_length", "front_fraction")


def _report(spark, sf):
    return coastal.roll_up(view(spark, sf, "drift"), view(spark, sf, "shore"), view(spark, sf, "clouds"))


def _plain(report):
    return report.withColumns({x: r6(c(x)) for x in _NUMBERS})


@query("segments_ranked", _ROLL + f"SELECT seg_id, name, state, cloud_fraction, n_detections, {', '.join(f'{s6(x)} AS {x}' for x in _NUMBERS)} FROM r")
def segments_ranked(spark, sf):
    return _plain(coastal.ranked(_report(spark, sf)))


@query("segments_order", _ROLL + f"SELECT seg_id, row_number() OVER (ORDER BY CASE state WHEN 'observed' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END, {s6('coverage')} DESC, {s6('front')} DESC, seg_id) AS place FROM r")
def segments_order(spark, sf):
    """The places of segments; a report has a row per segment, so that one window can rank them."""
    from pyspark.sql import Window

    return _plain(_report(spark, sf)).select("seg_id", F.row_number().over(Window.orderBy(*coastal._order())).alias("place"))


@query("segments_affected", _ROLL + f"SELECT seg_id, n_detections, {s6('area')} AS area FROM r WHERE n_detections > 0 AND state <> 'blind'")
def segments_affected(spark, sf):
    return _plain(coastal.affected(_report(spark, sf))).select("seg_id", "n_detections", "area")


@query("segments_blind", _ROLL + "SELECT seg_id, cloud_fraction FROM r WHERE state = 'blind'")
def segments_blind(spark, sf):
    return coastal.blind(_report(spark, sf)).select("seg_id", "cloud_fraction")


@query("segment_rows", _ROLL + f"SELECT seg_id, name, '2024-01-01' AS observed_on, state, round_even(cloud_fraction, 4) AS cloud_fraction, round_even({s6('coverage')}, 6) AS coverage, round_even({s6('area')}, 1) AS area, n_detections, 'x' AS scene_id FROM r")
def segment_rows(spark, sf):
    return coastal.rows(_plain(_report(spark, sf)), "2024-01-01", "x").drop("front", "front_length")


@query("segment_counts", f"SELECT seg_id, label, count(DISTINCT det_id) AS n FROM {_PAIRS} WHERE {_BOX_EDGE} <= 20 GROUP BY seg_id, label")
def segment_counts(spark, sf):
    return coastal.near(view(spark, sf, "drift"), view(spark, sf, "shore")).groupBy("seg_id", "label").agg(F.count_distinct("det_id").alias("n"))


@query("segment_union_area", f"WITH {_AREAS} SELECT seg_id, {s6('area')} AS area FROM u")
def segment_union_area(spark, sf):
    return coastal.union_area(view(spark, sf, "drift").filter(TARGETS), view(spark, sf, "shore")).select("seg_id", r6(c("area")).alias("area"))


@query("segment_zone_area", f"WITH {_AREAS} SELECT seg_id, {s6('zone_area')} AS zone_area FROM z")
def segment_zone_area(spark, sf):
    return coastal.zone_area(view(spark, sf, "shore")).select("seg_id", r6(c("zone_area")).alias("zone_area"))


@query("segment_front", f"WITH {_FRONT} SELECT seg_id, {s6('front')} AS front FROM f")
def segment_front(spark, sf):
    return coastal.front(view(spark, sf, "drift").filter(TARGETS), view(spark, sf, "shore")).select("seg_id", r6(c("front")).alias("front"))


@query("segment_cloud", f"""WITH p AS (SELECT scl, 12 * (c + 0.5e0) - 5 AS px, 7 * (r + 0.5e0) - 40 AS py FROM px), i AS (SELECT DISTINCT seg_id, px, py, scl IN (0, 1, 3, 8, 9, 10) AS cloud FROM p, shore
WHERE px BETWEEN least(x0, x1) - 20 AND greatest(x0, x1) + 20 AND py BETWEEN least(y0, y1) - 20 AND greatest(y0, y1) + 20 AND {_to_edge('px', 'py')} <= 20),
s AS (SELECT seg_id, avg(CASE WHEN cloud THEN 1e0 ELSE 0e0 END) AS f FROM i GROUP BY seg_id)
SELECT seg_id, {s6('coalesce(f, 1)')} AS cloud_fraction FROM (SELECT DISTINCT seg_id FROM shore) LEFT JOIN s USING (seg_id)""")
def segment_cloud(spark, sf):
    """Shares of the zones' pixels under cloud; zones outside the image count as not seen."""
    f = coastal.cloud_fractions(view(spark, sf, "px"), view(spark, sf, "shore"), (12.0, 0.0, -5.0, 0.0, 7.0, -40.0))
    return f.select("seg_id", r6(c("cloud_fraction")).alias("cloud_fraction"))


@query("observability", "SELECT n_nationkey AS seg_id, CASE WHEN coalesce(cloud_fraction, 0) > 0.7 THEN 'blind' WHEN coalesce(cloud_fraction, 0) > 0.2 THEN 'partial' ELSE 'observed' END AS state FROM nation LEFT JOIN clouds ON seg_id = n_nationkey")
def observability(spark, sf):
    s = spark.read.parquet(f"{sf}/nation.parquet").select(c("n_nationkey").alias("seg_id"))
    return s.join(view(spark, sf, "clouds"), "seg_id", "left").select("seg_id", coastal.observability(F.coalesce("cloud_fraction", F.lit(0.0))).alias("state"))


@query("segment_geojson", _ROLL + "SELECT seg_id, state, n_detections, (SELECT count(*) FROM shore t WHERE t.seg_id = r.seg_id) AS n_edges FROM r")
def segment_geojson(spark, sf):
    """The report as one collection of zones, read back."""
    shore = view(spark, sf, "shore")
    g = coastal.report_geojson(coastal.rows(_report(spark, sf)), coastal.zones(shore, 20.0), 20.0)
    shape = "features array<struct<id:string,geometry:struct<type:string,coordinates:array<array<array<array<double>>>>>,properties:struct<state:string,n_detections:bigint>>>"
    f = g.select(F.explode(F.from_json("value", shape)["features"]).alias("f"))
    return f.select(c("f.id").cast("long").alias("seg_id"), "f.properties.state", "f.properties.n_detections", F.size("f.geometry.coordinates").cast("long").alias("n_edges"))
