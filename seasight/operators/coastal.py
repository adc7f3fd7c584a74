"""Floating material rolled up onto named stretches of coast.

A segment is one or more edges (x0, y0)-(x1, y1) in a metric plane; its zone is
all within ``reach`` of any of them. Areas, zones and fronts are exact, but for
rounding: boxes are cut to the cells (of ``4 * reach``) that an edge's zone
meets, made disjoint there by slabs between their sides, and those that the
zone's border crosses are integrated between all places where it bends.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasight.functions.geo import finite_box, utm_inverse
from seasight.functions.spectral import cloud_mask
from seasight.lineage import keep
from seasight.operators.pairs import box_pairs

REACH = 20.0
TARGETS = ("sargassum", "marine_debris")
# Cloud fractions above which a segment is blind, or seen in part.
BLIND_ABOVE, PARTIAL_ABOVE = 0.70, 0.20


def edge_distance(x: Column, y: Column, *edge: Column) -> Column:
    """From a point to the edge (x0, y0)-(x1, y1), or another of four such columns."""
    x0, y0, x1, y1 = edge or map(F.col, ("x0", "y0", "x1", "y1"))
    dx, dy = x1 - x0, y1 - y0
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.least(F.greatest(((x - x0) * dx + (y - y0) * dy) / size, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    ex, ey = x - (x0 + t * dx), y - (y0 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def box_edge_distance() -> Column:
    """From a box to the edge; 0 where they touch. The nearest points of two that don't are a corner of the box or an end of the edge."""
    c = F.col

    def to_box(x: Column, y: Column) -> Column:
        dx, dy = F.greatest(c("xmin") - x, x - c("xmax"), F.lit(0.0)), F.greatest(c("ymin") - y, y - c("ymax"), F.lit(0.0))
        return F.sqrt(dx * dx + dy * dy)

    corners = [edge_distance(c(x), c(y)) for x in ("xmin", "xmax") for y in ("ymin", "ymax")]
    # the part of the edge, from 0 to 1, that is in the box's stretch of either axis
    enter, leave = F.lit(0.0), F.lit(1.0)
    for a, b, lo, hi in (("x0", "x1", "xmin", "xmax"), ("y0", "y1", "ymin", "ymax")):
        d = c(b) - c(a)
        t0, t1 = (c(lo) - c(a)) / d, (c(hi) - c(a)) / d
        inside = c(a).between(c(lo), c(hi))
        enter = F.greatest(enter, F.when(d != 0, F.least(t0, t1)).otherwise(F.when(inside, 0.0).otherwise(2.0)))
        leave = F.least(leave, F.when(d != 0, F.greatest(t0, t1)).otherwise(F.when(inside, 1.0).otherwise(-1.0)))
    return F.when(enter <= leave, F.lit(0.0)).otherwise(F.least(to_box(c("x0"), c("y0")), to_box(c("x1"), c("y1")), *corners))


def _edges(segs: DataFrame, reach: float) -> DataFrame:
    """The edges of ``segs`` by their pieces of ``4 * reach`` at most (u0, v0)-(u1, v1), each with its box, grown by ``reach``."""
    c = F.col
    s = segs.select("seg_id", c("image").alias("s_image"), "x0", "y0", "x1", "y1").distinct()
    s = s.withColumn("n", F.greatest(F.ceil(edge_length() / (4 * reach)), F.lit(1))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), c("n") - 1)))
    at = lambda a, b, k: F.when(k == c("n"), c(b)).otherwise(c(a) + (c(b) - c(a)) * k / c("n"))
    s = s.withColumns({f"{w}{i}": at(f"{x}0", f"{x}1", c("k") + i) for w, x in (("u", "x"), ("v", "y")) for i in (0, 1)})
    grown = {"gx0": F.least("u0", "u1") - reach, "gy0": F.least("v0", "v1") - reach, "gx1": F.greatest("u0", "u1") + reach, "gy1": F.greatest("v0", "v1") + reach}
    return s.withColumns(grown).drop("n", "k")


def meet(dets: DataFrame, segs: DataFrame, reach: float) -> DataFrame:
    """Detections of an image beside the pieces of edges whose boxes, grown by ``reach``, they overlap: what the other functions begin with. Boxes with an end that is no number have no place, and are left out."""
    d = dets.filter(finite_box()).select("det_id", "image", "label", "xmin", "ymin", "xmax", "ymax")
    return keep(box_pairs(d, _edges(segs, reach), {"image": "s_image"}, ("xmin", "ymin", "xmax", "ymax"), ("gx0", "gy0", "gx1", "gy1"), 4 * reach))


def near(dets: DataFrame, segs: DataFrame, reach: float = REACH, met: DataFrame | None = None) -> DataFrame:
    """Detections that touch the zone of an edge of the same image, with their distance from it."""
    met = meet(dets, segs, reach) if met is None else met
    pairs = met.select("det_id", "image", "label", "xmin", "ymin", "xmax", "ymax", "seg_id", "x0", "y0", "x1", "y1").distinct()
    return pairs.withColumn("distance", box_edge_distance()).filter(F.col("distance") <= reach)


def _by_cell(df: DataFrame, reach: float, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """``df`` by the cells (cx, cy) that the box meets, with its part of each: a, l, b, h."""
    g = 4 * reach
    d = df.withColumns({"a": x0, "l": y0, "b": x1, "h": y1}).filter("a < b and l < h")
    for c, lo, hi in (("cx", "a", "b"), ("cy", "l", "h")):
        d = d.withColumn(c, F.explode(F.sequence(F.floor(F.col(lo) / g), F.ceil(F.col(hi) / g) - 1)))
        d = d.withColumns({lo: F.greatest(lo, F.col(c) * g), hi: F.least(hi, (F.col(c) + 1) * g)})
    return d


def _disjoint(rects: DataFrame) -> DataFrame:
    """seg_id, cx, cy and rectangles a, l, b, h that cover what those of ``rects`` do, without overlaps: slabs between their sides, and in each the union of their stretches."""
    cell = ["seg_id", "cx", "cy"]
    ends = rects.select(*cell, F.explode(F.array("a", "b")).alias("s")).distinct()
    slabs = ends.withColumn("t", F.lead("s").over(Window.partitionBy(*cell).orderBy("s"))).filter("t is not null")
    d = rects.join(slabs, cell).filter("a <= s and b >= t").select(*cell, "s", "t", "l", "h").distinct()
    w = Window.partitionBy(*cell, "s").orderBy("l", "h")
    d = d.withColumn("upto", F.max("h").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("run", F.sum(F.when(F.col("upto") >= F.col("l"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*cell, F.col("s").alias("a"), F.col("t").alias("b"), "run").agg(F.min("l").alias("l"), F.max("h").alias("h")).drop("run")


def part_in_zone(a: float, l: float, b: float, h: float, edges: np.ndarray, reach: float) -> float:  # noqa: E741
    """The area of the rectangle from (a, l) to (b, h) within ``reach`` of an edge (rows x0, y0, x1, y1).

    Between two neighbours among all places where arcs and sides of the zones
    begin, end, or cross each other or the rectangle, nothing crosses, so that
    mean heights there make up the union as heights do; those of arcs and sides
    are known.
    """
    x0, y0, x1, y1 = edges.T
    dx, dy = x1 - x0, y1 - y0
    size = np.hypot(dx, dy)
    u = np.stack([dx, dy], 1)[size > 0] / size[size > 0, None]
    n = reach * np.stack([-u[:, 1], u[:, 0]], 1)
    ends = edges[size > 0].reshape(-1, 2, 2)
    corners = np.concatenate([ends + n[:, None], ends - n[:, None]]).reshape(-1, 2)
    c = edges.reshape(-1, 2)
    q = np.concatenate([ends[:, 0] + n, ends[:, 0] - n, [[0, l], [0, h]]])
    v = np.concatenate([u, u, [[1, 0], [1, 0]]])
    xs = [np.array([a, b]), c[:, 0] - reach, c[:, 0] + reach, corners[:, 0]]
    i, j = np.triu_indices(len(c), 1)
    d, m = c[j] - c[i], (c[j] + c[i]) / 2
    far = np.hypot(*d.T)
    ok = (far > 0) & (far <= 2 * reach)
    off = np.sqrt(reach**2 - far[ok] ** 2 / 4) * d[ok, 1] / far[ok]
    xs += [m[ok, 0] - off, m[ok, 0] + off]
    w = c[:, None] - q[None]
    across, along = v[None, :, 0] * w[..., 1] - v[None, :, 1] * w[..., 0], (v[None] * w).sum(-1)
    half = np.sqrt(np.maximum(reach**2 - across**2, 0)) * v[None, :, 0]
    ok = np.abs(across) <= reach
    foot = q[None, :, 0] + along * v[None, :, 0]
    xs += [(foot - half)[ok], (foot + half)[ok]]
    det = v[:, None, 0] * v[None, :, 1] - v[:, None, 1] * v[None, :, 0]
    r = q[None] - q[:, None]
    ok = np.abs(det) > 1e-12
    xs.append((q[:, None, 0] + v[:, None, 0] * (r[..., 0] * v[None, :, 1] - r[..., 1] * v[None, :, 0]) / np.where(ok, det, 1))[ok])
    x = np.unique(np.clip(np.concatenate(xs), a, b))
    x = x[np.concatenate([[True], np.diff(x) > 1e-12 * np.maximum(1, np.abs(x[1:]))])]
    begin, end = x[:-1, None], x[1:, None]
    mid, wide = (begin + end) / 2, end - begin
    # of a zone, the highest and lowest points at x are over the edge's point to which they are upright, or over its end
    lean = np.where(size > 0, -dy * np.sign(dx) / np.where(size > 0, size, 1), 0) * reach

    def under(v: np.ndarray) -> np.ndarray:
        """Of half a circle, the area from its middle to v."""
        v = np.clip(v, -reach, reach)
        return (v * np.sqrt(reach**2 - v**2) + reach**2 * np.arcsin(v / reach)) / 2

    def mean(way: int) -> np.ndarray:
        t = np.where(dx != 0, (mid - way * lean - x0) / np.where(dx != 0, dx, 1), way * np.sign(dy))
        t = np.clip(t, 0, 1)
        at = x0 + t * dx
        rest = reach**2 - (mid - at) ** 2
        over = np.where((t == 0) | (t == 1), (under(end - at) - under(begin - at)) / wide, np.sqrt(np.maximum(rest, 0)))
        return np.where(rest >= 0, y0 + t * dy + way * over, np.nan)

    low, high = np.maximum(mean(-1), l), np.minimum(mean(1), h)
    low, high = np.where(high > low, low, np.inf), np.where(high > low, high, -np.inf)
    order = np.argsort(low, axis=1)
    low, high = np.take_along_axis(low, order, 1), np.take_along_axis(high, order, 1)
    upto = np.maximum.accumulate(np.concatenate([np.full((len(mid), 1), -np.inf), high[:, :-1]], 1), axis=1)
    heights = np.where(high > low, np.maximum(high - np.maximum(low, upto), 0), 0).sum(1)
    return float(heights @ wide[:, 0])


def _area(rects: DataFrame, segs: DataFrame, reach: float, name: str) -> DataFrame:
    """seg_id and the area of a segment's ``rects``, disjoint and by cells, inside its zone."""
    c = F.col
    edges = _by_cell(_edges(segs, reach), reach, *map(c, ("gx0", "gy0", "gx1", "gy1")))
    edges = edges.groupBy("seg_id", "cx", "cy").agg(F.array_sort(F.collect_set(F.array("x0", "y0", "x1", "y1"))).alias("edges"))
    d = keep(rects.select("seg_id", "cx", "cy", "a", "l", "b", "h").join(edges, ["seg_id", "cx", "cy"]))

    def holds(e: Column) -> Column:
        """Zones are convex: one that has the corners has the rectangle."""
        out = F.lit(True)
        for x in ("a", "b"):
            for y in ("l", "h"):
                out = out & (edge_distance(c(x), c(y), *[e[i] for i in range(4)]) <= reach)
        return out

    inside = F.exists("edges", holds)

    @F.pandas_udf("double")
    def crossed(a: pd.Series, l: pd.Series, b: pd.Series, h: pd.Series, edges: pd.Series) -> pd.Series:  # noqa: E741
        return pd.Series([part_in_zone(*box, np.stack(e), reach) for *box, e in zip(a, l, b, h, edges)], dtype=float)

    whole = d.filter(inside).select("seg_id", ((c("b") - c("a")) * (c("h") - c("l"))).alias("s"))
    part = d.filter(~inside).select("seg_id", crossed("a", "l", "b", "h", "edges").alias("s"))
    return whole.union(part).groupBy("seg_id").agg(F.sum("s").alias(name)).filter(c(name) > 0)


def union_area(dets: DataFrame, segs: DataFrame, reach: float = REACH, met: DataFrame | None = None) -> DataFrame:
    """seg_id, area: of what detections cover of a segment's zone, counted once."""
    met = meet(dets, segs, reach) if met is None else met
    rects = _by_cell(met, reach, F.greatest("xmin", "gx0"), F.greatest("ymin", "gy0"), F.least("xmax", "gx1"), F.least("ymax", "gy1"))
    return _area(_disjoint(rects.select("seg_id", "cx", "cy", "a", "l", "b", "h").distinct()), segs, reach, "area")


def zone_area(segs: DataFrame, reach: float = REACH) -> DataFrame:
    """seg_id, zone_area: of all within ``reach`` of the segment's edges."""
    g = 4 * reach
    cells = _by_cell(_edges(segs, reach), reach, *map(F.col, ("gx0", "gy0", "gx1", "gy1"))).select("seg_id", "cx", "cy").distinct()
    return _area(cells.withColumns({"a": F.col("cx") * g, "l": F.col("cy") * g, "b": (F.col("cx") + 1) * g, "h": (F.col("cy") + 1) * g}), segs, reach, "zone_area")


def reached(reach: float) -> tuple[Column, Column]:
    """Of a piece (u0, v0)-(u1, v1) of an edge, from where to where, as shares of it, it lies within ``reach`` of the box; null where it doesn't.

    All within reach of a box is it grown along either axis, and circles at its corners.
    """
    c = F.col
    dx, dy = c("u1") - c("u0"), c("v1") - c("v0")
    size = dx * dx + dy * dy
    spans = []

    def found(lo: Column, hi: Column, cond: Column) -> None:
        spans.append(F.struct(lo.alias("lo"), hi.alias("hi"), cond.alias("ok")))

    for gx, gy in ((reach, 0.0), (0.0, reach)):
        enter, leave = F.lit(0.0), F.lit(1.0)
        for a, d, lo, hi in ((c("u0"), dx, c("xmin") - gx, c("xmax") + gx), (c("v0"), dy, c("ymin") - gy, c("ymax") + gy)):
            t0, t1, level = F.when(d != 0, (lo - a) / d), F.when(d != 0, (hi - a) / d), a.between(lo, hi)
            enter = F.greatest(enter, F.when(d != 0, F.least(t0, t1)).otherwise(F.when(level, 0.0).otherwise(2.0)))
            leave = F.least(leave, F.when(d != 0, F.greatest(t0, t1)).otherwise(F.when(level, 1.0).otherwise(-1.0)))
        found(enter, leave, enter <= leave)
    for x in ("xmin", "xmax"):
        for y in ("ymin", "ymax"):
            px, py = c("u0") - c(x), c("v0") - c(y)
            along, rest = dx * px + dy * py, px * px + py * py - reach * reach
            root = along * along - size * rest
            wide = F.sqrt(F.greatest(root, F.lit(0.0)))
            found((-along - wide) / size, (-along + wide) / size, root >= 0)
    real = F.filter(F.array(*spans), lambda s: s["ok"] & (s["lo"] <= 1) & (s["hi"] >= 0))
    ends = F.transform(real, lambda s: F.struct(F.greatest(s["lo"], F.lit(0.0)).alias("lo"), F.least(s["hi"], F.lit(1.0)).alias("hi")))
    return F.array_min(F.transform(ends, lambda s: s["lo"])), F.array_max(F.transform(ends, lambda s: s["hi"]))


def front(dets: DataFrame, segs: DataFrame, reach: float = REACH, met: DataFrame | None = None) -> DataFrame:
    """seg_id, front: the length of each segment that has a detection within ``reach``."""
    met = meet(dets, segs, reach) if met is None else met
    piece, c = ["seg_id", "u0", "v0", "u1", "v1"], F.col
    t0, t1 = reached(reach)
    d = met.filter("u0 <> u1 or v0 <> v1").select(*piece, t0.alias("t0"), t1.alias("t1")).filter("t0 < t1").distinct()
    upto = F.max("t1").over(Window.partitionBy(*piece).orderBy("t0", "t1").rowsBetween(Window.unboundedPreceding, -1))
    length = F.sqrt((c("u1") - c("u0")) * (c("u1") - c("u0")) + (c("v1") - c("v0")) * (c("v1") - c("v0")))
    new = F.greatest(c("t1") - F.greatest("t0", upto), F.lit(0.0))
    return d.withColumn("new", new * length).groupBy("seg_id").agg(F.sum("new").alias("front"))


def edge_length() -> Column:
    c = F.col
    return F.sqrt((c("x1") - c("x0")) * (c("x1") - c("x0")) + (c("y1") - c("y0")) * (c("y1") - c("y0")))


def observability(cloud: Column, blind_above: float = BLIND_ABOVE, partial_above: float = PARTIAL_ABOVE) -> Column:
    return F.when(cloud > blind_above, "blind").when(cloud > partial_above, "partial").otherwise("observed")


def cloud_fractions(px: DataFrame, segs: DataFrame, transform: tuple[float, ...], reach: float = REACH) -> DataFrame:
    """seg_id, cloud_fraction: the share of a zone's pixels under cloud, by their centres; a segment whose zone has no pixel is not seen, and has 1.

    ``px`` has r, c and scl; ``transform`` is (a, b, c, d, e, f) of an image whose rows and columns run along the axes.
    """
    a, b, x, d, e, y = transform
    if b or d:
        raise ValueError("the image must lie along the axes")
    px = px.select("scl", (a * (F.col("c") + 0.5) + x).alias("px"), (e * (F.col("r") + 0.5) + y).alias("py"))
    grid, c = 4 * reach, F.col
    span = lambda lo, hi: F.explode(F.sequence(F.floor((F.least(lo, hi) - reach) / grid), F.floor((F.greatest(lo, hi) + reach) / grid)))
    s = segs.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))
    p = px.withColumns({"cx": F.floor(c("px") / grid), "cy": F.floor(c("py") / grid)})
    inside = p.join(s, ["cx", "cy"]).filter(edge_distance(c("px"), c("py")) <= reach).select("seg_id", "px", "py", cloud_mask().alias("cloud")).distinct()
    share = inside.groupBy("seg_id").agg(F.avg(c("cloud").cast("double")).alias("cloud_fraction"))
    return segs.select("seg_id").distinct().join(share, "seg_id", "left").select("seg_id", F.coalesce("cloud_fraction", F.lit(1.0)).alias("cloud_fraction"))


def check(reach: float, blind_above: float = BLIND_ABOVE, partial_above: float = PARTIAL_ABOVE) -> None:
    if reach <= 0:
        raise ValueError(f"reach must be above 0, got {reach}")
    if not 0 <= partial_above <= blind_above <= 1:
        raise ValueError(f"need 0 <= partial_above <= blind_above <= 1, got {partial_above} and {blind_above}")


def roll_up(
    dets: DataFrame,
    segs: DataFrame,
    clouds: DataFrame,
    labels: tuple[str, ...] | None = TARGETS,
    reach: float = REACH,
    blind_above: float = BLIND_ABOVE,
    partial_above: float = PARTIAL_ABOVE,
) -> DataFrame:
    """seg_id, name, state, cloud_fraction, coverage, area, front, front_length, front_fraction, n_detections: one row per segment.

    ``segs`` has a row per edge. n_detections counts the boxes that touch the
    zone, area is that of their union inside it, coverage its share of the zone,
    front the length of coast within ``reach`` of one. A segment without a cloud
    figure is clear; one out of 0 to 1 is an error. No ``labels``: all count.
    """
    check(reach, blind_above, partial_above)
    if segs.isEmpty():
        raise ValueError("there are no segments")
    own = dets if labels is None else dets.filter(F.col("label").isin(list(labels)))
    segs = keep(segs)
    met = meet(own, segs, reach)
    hits = near(own, segs, reach, met).groupBy("seg_id").agg(F.count_distinct("det_id").alias("n_detections"))
    lengths = segs.groupBy("seg_id").agg(F.min("name").alias("name"), F.sum(edge_length()).alias("front_length"))
    out = lengths
    for part in (hits, union_area(own, segs, reach, met), zone_area(segs, reach), front(own, segs, reach, met), clouds.select("seg_id", F.col("cloud_fraction").cast("double").alias("cloud"))):
        out = out.join(part, "seg_id", "left")
    c, zero = F.col, lambda name: F.coalesce(name, F.lit(0.0))
    cloud = zero("cloud")
    cloud = F.when(cloud.between(0, 1), cloud).otherwise(F.raise_error(F.concat(F.lit("cloud fractions must be from 0 to 1, got "), cloud.cast("string"))).cast("double"))
    out = out.withColumn("cloud_fraction", cloud)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = out.select(
        "seg_id",
        "name",
        observability(c("cloud_fraction"), blind_above, partial_above).alias("state"),
        "cloud_fraction",
        share(zero("area"), zero("zone_area")).alias("coverage"),
        zero("area").alias("area"),
        zero("front").alias("front"),
        "front_length",
        share(zero("front"), c("front_length")).alias("front_fraction"),
        F.coalesce("n_detections", F.lit(0)).alias("n_detections"),
    )
    return keep(out)  # a row per segment, and read more than once where it is ranked


def _order() -> list[Column]:
    state = F.when(F.col("state") == "observed", 0).when(F.col("state") == "partial", 1).otherwise(2)
    return [state, F.desc("coverage"), F.desc("front"), F.asc("seg_id")]


def ranked(report: DataFrame) -> DataFrame:
    """``report`` in order: observed, partial, blind, then by falling coverage and front."""
    return report.orderBy(*_order())


def affected(report: DataFrame) -> DataFrame:
    """Segments with detections, where they could be seen."""
    return report.filter((F.col("n_detections") > 0) & (F.col("state") != "blind"))


def blind(report: DataFrame) -> DataFrame:
    """Segments that couldn't be seen: no detection there means nothing."""
    return report.filter(F.col("state") == "blind")


def rows(report: DataFrame, observed_on: str = "", scene_id: str = "") -> DataFrame:
    """``report`` in order, as flat rows for files: fractions to 4 digits, coverage to 6, areas and lengths to one, half to even, no name as the id."""
    r = lambda name, digits: F.bround(name, digits).alias(name)
    return ranked(report).select(
        "seg_id", F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("seg_id").cast("string")).alias("name"), F.lit(observed_on).alias("observed_on"), "state",
        r("cloud_fraction", 4), r("coverage", 6), r("area", 1), r("front", 1), r("front_length", 1), "n_detections", F.lit(scene_id).alias("scene_id"),
    )


def zones(segs: DataFrame, reach: float, zone: int | None = None, sides: int = 16) -> DataFrame:
    """seg_id, geometry (GeoJSON): every segment's zone as the outlines of all that is within ``reach`` of an edge, in degrees if ``zone`` names the UTM zone of the plane."""
    check(reach)
    c = F.col
    turn = F.atan2(c("y1") - c("y0"), c("x1") - c("x0"))

    def end(k: int) -> Column:
        """Half a circle around an end of the edge, on its far side."""
        x, y = (c("x1"), c("y1")) if k else (c("x0"), c("y0"))
        from_angle = turn - math.pi / 2 if k else turn + math.pi / 2
        points = [(x + reach * F.cos(from_angle + math.pi * i / sides), y + reach * F.sin(from_angle + math.pi * i / sides)) for i in range(sides + 1)]
        if zone is not None:
            points = [utm_inverse(px, py, F.lit(zone)) for px, py in points]
        return F.array(*[F.array(px, py) for px, py in points])

    ring = F.concat(end(1), end(0))
    closed = F.concat(ring, F.slice(ring, 1, 1))
    shape = segs.groupBy("seg_id").agg(F.sort_array(F.collect_list(F.array(closed))).alias("coordinates"))  # a segment's edges
    return shape.select("seg_id", F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), "coordinates")).alias("geometry"))


def report_geojson(flat: DataFrame, shapes: DataFrame, reach: float, observed_on: str = "", scene_id: str = "", crs: str = "") -> DataFrame:
    """value: one row, the FeatureCollection of a report's ``rows`` with their ``zones``; a report has a row per segment."""
    props = [x for x in flat.columns if x != "seg_id"]
    c = F.col
    one = flat.join(shapes, "seg_id").withColumn("k", F.struct(*[e for e in (F.when(c("state") == "observed", 0).when(c("state") == "partial", 1).otherwise(2), -c("coverage"), -c("front"), c("seg_id"))]))
    text = F.concat(
        F.lit('{"type":"Feature","id":'), F.to_json(F.array(c("seg_id").cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(c("seg_id").cast("string")))) - 2),
        F.lit(',"geometry":'), "geometry", F.lit(',"properties":'), F.to_json(F.struct("seg_id", *props)), F.lit("}"),
    )
    head = {"observed_on": observed_on, "scene_id": scene_id, "surf_zone_m": reach, "metric_crs": crs}
    every = one.agg(F.array_sort(F.collect_list(F.struct("k", text.alias("f")))).alias("f"), F.count("*").alias("n"), F.count_if(c("state") == "blind").alias("blind"), F.count_if((c("n_detections") > 0) & (c("state") != "blind")).alias("hit"))
    properties = F.to_json(F.struct(c("n").alias("count"), *[F.lit(v).alias(k) for k, v in head.items()], c("blind").alias("blind_segments"), c("hit").alias("affected_segments")))
    return every.select(
        F.concat(
            F.lit('{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:OGC:1.3:CRS84"}},"features":['),
            F.array_join(F.transform("f", lambda x: x["f"]), ","), F.lit('],"properties":'), properties, F.lit("}"),
        ).alias("value")
    )


def append_history(report: DataFrame, path: str, observed_on: str) -> None:
    """Append to the history table, by day; it is never made distinct."""
    report.withColumn("observed_on", F.lit(observed_on)).write.mode("append").partitionBy("observed_on").parquet(path)
