"""Registered queries of whole scenes' regions and of chips chosen among candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from seasight.functions import geo
from seasight.operators import patches, polygons, regions, screening
from seasight.plans.queries import _CANDIDATES, _CLOUD, _PAIRS, _WATER, query, r6, s6
from seasight.views import view

c = F.col


def _reach(mask: str, connectivity: int, more: str = "") -> str:
    """Regions of the scene by a recursive walk from every pixel of the mask; pid goes by rows."""
    near = "abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1" if connectivity == 8 else "abs(a.r - b.r) + abs(a.c - b.c) = 1"
    return f"""k AS ({mask}),
reach AS (SELECT r, c, pid, pid AS root FROM k UNION SELECT b.r, b.c, b.pid, a.root FROM reach a JOIN k b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND {near}),
l AS (SELECT r, c, pid, min(root) AS root FROM reach GROUP BY ALL),
regions AS (SELECT root, min(l.c) AS xmin, min(l.r) AS ymin, max(l.c) + 1 AS xmax, max(l.r) + 1 AS ymax, count(*) AS n_pixels{more} FROM l{' JOIN k USING (pid)' if more else ''} GROUP BY root)"""


def _one_connectivity(n: int) -> None:
    @query(f"scene_regions_{n}", f"WITH RECURSIVE {_CANDIDATES}, {_reach('SELECT pid, r, c FROM m WHERE candidate', n)} SELECT root // 100 AS first_r, root % 100 AS first_c, xmin, ymin, xmax, ymax, n_pixels FROM regions WHERE n_pixels >= 2")
    def run(spark, sf):
        """Regions that go on over the tiles of the screening and over the blocks of the labelling."""
        px = screening.candidates(view(spark, sf, "px"), 0.95).withColumn("image", F.lit(0))
        return regions.scene_regions(px, connectivity=n, least=2, block=32).drop("image")


_one_connectivity(8)
_one_connectivity(4)


_HITS = f"SELECT pid, r, c, nir * 10 AS score FROM px WHERE coalesce(nir * 10 >= 0.15e0, false) AND {_WATER} AND NOT {_CLOUD}"


@query("scored_boxes", "WITH RECURSIVE " + _reach(_HITS, 4, ", max(score) AS score") + f" SELECT 'sargassum' AS label, {s6('score')} AS score, CAST(xmin AS DOUBLE) AS xmin, CAST(ymin AS DOUBLE) AS ymin, CAST(xmax AS DOUBLE) AS xmax, CAST(ymax AS DOUBLE) AS ymax FROM regions WHERE n_pixels >= 2")
def scored_boxes(spark, sf):
    """Pixels that score, gated by water and cloud, as boxes."""
    px = view(spark, sf, "px").withColumns({"image": F.lit(0), "p": c("nir") * 10})
    return regions.scored_boxes(px, "p", 0.15, "sargassum", least=2, block=32).select("label", r6(c("score")).alias("score"), "xmin", "ymin", "xmax", "ymax")


_CHIPS = """z AS (SELECT r // 40 AS image, r % 40 AS r, c, nir, scl FROM px),
w AS (SELECT image, r0, c0, count(*) AS n_pixels, count(*) FILTER (WHERE nir > 0.012e0) AS n_wanted, count(*) FILTER (WHERE nir IS NULL) / count(*) AS no_data, count(*) FILTER (WHERE scl = 6) / count(*) AS water, count(*) FILTER (WHERE scl IN (8, 9, 10)) / count(*) AS cloud
  FROM z, (SELECT unnest(range(-5, 45, 5)) AS r0), (SELECT unnest(range(-5, 105, 5)) AS c0) WHERE r >= r0 AND r < r0 + 10 AND c >= c0 AND c < c0 + 10 GROUP BY image, r0, c0),
g AS (SELECT *, CASE WHEN n_pixels < 100 THEN 'outside the scene' WHEN no_data > 0.02e0 THEN 'no data' WHEN water < 0.72e0 THEN 'too little water' WHEN cloud > 0.26e0 THEN 'cloud' WHEN n_wanted < 10 THEN 'too few wanted pixels' END AS reason FROM w)"""


def _chips(spark, sf):
    px = view(spark, sf, "px").withColumns({"image": F.floor(c("r") / 40), "r": c("r") % 40})
    return patches.chip_windows(px, 10, 5, c("nir") > 0.012, c("nir").isNull(), 0.72, 10, 0.26)


@query("chip_windows", f"WITH {_CHIPS} SELECT image, CAST(r0 AS BIGINT) AS r0, CAST(c0 AS BIGINT) AS c0, n_pixels, n_wanted, {s6('no_data')} AS no_data, {s6('water')} AS water, {s6('cloud')} AS cloud, reason FROM g")
def chip_windows(spark, sf):
    """Every candidate window with the reason that rejects it."""
    return _chips(spark, sf).withColumns({x: r6(c(x)) for x in ("no_data", "water", "cloud")})


_CHOICE = f"""WITH RECURSIVE {_CHIPS},
o AS (SELECT image, r0, c0, row_number() OVER (PARTITION BY image ORDER BY n_wanted DESC, r0, c0) AS k FROM g WHERE reason IS NULL),
s AS (SELECT image, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(y BIGINT, x BIGINT)[]) AS took, false AS chosen, CAST(NULL AS BIGINT) AS r0, CAST(NULL AS BIGINT) AS c0 FROM (SELECT DISTINCT image FROM o)
  UNION ALL SELECT s.image, o.k, CASE WHEN len(list_filter(took, lambda t: abs(t.y - o.r0) < 10 AND abs(t.x - o.c0) < 10)) = 0 THEN list_append(took, {{'y': CAST(o.r0 AS BIGINT), 'x': CAST(o.c0 AS BIGINT)}}) ELSE took END, len(list_filter(took, lambda t: abs(t.y - o.r0) < 10 AND abs(t.x - o.c0) < 10)) = 0, o.r0, o.c0 FROM s JOIN o ON s.image = o.image AND o.k = s.k + 1)"""


@query("chosen_chips", f"{_CHOICE} SELECT g.image, CAST(g.r0 AS BIGINT) AS r0, CAST(g.c0 AS BIGINT) AS c0, g.n_wanted, CASE WHEN g.reason IS NOT NULL THEN g.reason WHEN NOT s.chosen THEN 'overlaps a better chip' END AS reason, coalesce(s.chosen, false) AS chosen FROM g LEFT JOIN s ON g.image = s.image AND g.r0 = s.r0 AND g.c0 = s.c0")
def chosen_chips(spark, sf):
    """Chips that don't overlap, best first, and why the others are out."""
    return patches.choose_chips(_chips(spark, sf), 10).select("image", "r0", "c0", "n_wanted", "reason", "chosen")


@query("footprint_pairs", f"WITH p AS ({_PAIRS}) SELECT det_id, gt_id, {s6('iou')} AS iou FROM p")
def footprint_pairs(spark, sf):
    """Boxes through a turning, shearing map: their overlap is that of the boxes, as such a map keeps shares of areas."""
    ring = geo.box_ring((0.8, 0.3, 100.0, -0.2, 1.1, 50.0))
    d, g = (view(spark, sf, x).withColumn("ring", ring) for x in ("dets", "gts"))
    return polygons.footprint_pairs(d, g, keys=("image", "label")).select("det_id", "gt_id", r6(c("iou")).alias("iou"))
