"""Convex rings (arrays of x, y without the first corner again): area, overlap, and pairs that overlap.

Boxes that went through an affine map are such rings, turned or sheared; their
overlap is the ring clipped by the other's sides, all as column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasight.operators.pairs import box_pairs

RING = "array<struct<x: double, y: double>>"


def _next(ring: Column, i: Column) -> Column:
    return F.get(ring, (i + 1) % F.size(ring))


def _once(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def signed_area(ring: Column) -> Column:
    """Positive where the corners go against the clock (y upwards); 0 for fewer than three corners, NULL for no ring."""

    def of(r: Column) -> Column:
        o = F.get(r, F.lit(0))  # from the first corner, so that far places lose no digits
        cross = F.transform(r, lambda p, i: (p["x"] - o["x"]) * (_next(r, i)["y"] - o["y"]) - (_next(r, i)["x"] - o["x"]) * (p["y"] - o["y"]))
        return F.when(r.isNotNull(), F.coalesce(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v), F.lit(0.0)) / 2)

    return _once(ring.cast(RING), of)


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def clip(ring: Column, p: Column, q: Column) -> Column:
    """What of the ring is left of the line from ``p`` to ``q``, the line itself included."""
    side = lambda v: (q["x"] - p["x"]) * (v["y"] - p["y"]) - (q["y"] - p["y"]) * (v["x"] - p["x"])

    def corner(v: Column, i: Column) -> Column:
        w = _next(ring, i)
        s, t = side(v), side(w)
        k = s / (s - t)
        cut = F.struct((v["x"] + k * (w["x"] - v["x"])).alias("x"), (v["y"] + k * (w["y"] - v["y"])).alias("y"))
        none = F.lit(None).cast("struct<x: double, y: double>")
        return F.array_compact(F.array(F.when(s >= 0, v).otherwise(none), F.when(s * t < 0, cut).otherwise(none)))

    return F.flatten(F.transform(ring, corner)).cast(RING)


def overlap_ring(a: Column, b: Column) -> Column:
    """The ring that two convex rings share, whichever way their corners go; empty if none. A ring without area shares none."""
    a, b = a.cast(RING), b.cast(RING)
    sides = F.transform(b, lambda p, i: F.struct(p.alias("p"), _next(b, i).alias("q")))
    turned = F.transform(b, lambda p, i: F.struct(_next(b, i).alias("p"), p.alias("q")))
    way = signed_area(b)
    sides = F.when(way > 0, sides).when(way < 0, turned)
    none = F.slice(a, 1, 0)
    return F.coalesce(F.aggregate(sides, a, lambda left, s: clip(left, s["p"], s["q"])), none)


def ring_iou(a: Column, b: Column) -> Column:
    """Shared area over the area of both; 0 where neither has any."""
    both = ring_area(overlap_ring(a, b))
    union = ring_area(a) + ring_area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def footprint_pairs(a: DataFrame, b: DataFrame, least: float = 0.5, cell: float = 16.0, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """det_id, gt_id, shared, iou: convex footprints of ``a`` (det_id, keys, ring) and ``b`` (gt_id, keys, ring) of equal keys that overlap with an IoU of ``least`` or more.

    Bounding boxes meet by levels of size (``box_pairs``), rings decide. Pairs
    without shared area go, as do footprints without a ring or one of the keys.
    """
    c = F.col

    def side(df: DataFrame, key: str, x: str) -> DataFrame:
        at = lambda f, k: f(F.transform("ring", lambda p: p[k])).cast("double")
        ends = {f"{x}x0": at(F.array_min, "x"), f"{x}y0": at(F.array_min, "y"), f"{x}x1": at(F.array_max, "x"), f"{x}y1": at(F.array_max, "y")}
        of = F.struct(*[v.alias(k) for k, v in (ends | {f"{x}area": ring_area(c("ring"))}).items()])
        d = df.filter("size(ring) > 2").select(key, *[c(k).alias(f"{x}{k}") for k in keys], c("ring").alias(f"{x}ring"), F.inline(F.array(of)))  # once a ring
        return d.filter(c(f"{x}area") > 0)  # others share none

    box = lambda x: tuple(f"{x}{k}" for k in ("x0", "y0", "x1", "y1"))
    p = box_pairs(side(a, "det_id", "p_"), side(b, "gt_id", "q_"), {f"p_{k}": f"q_{k}" for k in keys}, box("p_"), box("q_"), cell)

    def length(k: str) -> Column:
        ends = [c(f"{x}{k}{i}") for x in ("p_", "q_") for i in (0, 1)]
        slack = sum((F.abs(e) for e in ends), F.lit(0.0)) * 1e-9
        return F.least(ends[1], ends[3]) - F.greatest(ends[0], ends[2]) + slack

    # the boxes' overlap is no smaller than the rings': what it already leaves below ``least`` isn't clipped
    whole = c("p_area") + c("q_area")
    p = p.filter(length("x") * length("y") * (1 + least) >= least * whole * (1 - 1e-6))
    found = lambda s: F.struct(s.alias("shared"), (s / (whole - s)).alias("iou"))
    both = F.transform(F.array(ring_area(overlap_ring(c("p_ring"), c("q_ring")))), found)
    # filtered within the array, as a filter on a column would clip each pair anew for every name in it
    return p.select("det_id", "gt_id", F.inline(F.filter(both, lambda x: (x["shared"] > 0) & (x["iou"] >= least))))
