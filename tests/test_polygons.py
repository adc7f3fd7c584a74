"""Overlaps of convex rings against fine counts of points, and their edges."""

import numpy as np
from pyspark.sql import functions as F

from seasight.operators import polygons

KIND = "a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>"


def inside(ring, x, y):
    p, q = np.array(ring), np.roll(np.array(ring), -1, 0)
    s = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(p, q)]
    return np.all(np.array(s) >= 0, 0) | np.all(np.array(s) <= 0, 0)


def test_overlaps_of_turned_boxes(spark):
    """Turned boxes in both directions of their corners, and triangles; far from the origin, too."""
    g = np.random.default_rng(6)
    rows = []
    for i in range(40):
        pair = []
        for _ in range(2):
            t, w, h = g.random() * 6.28, *(g.random(2) * 4 + 1)
            box = np.array([(-w, -h), (w, -h), (w, h), (-w, h)])[: 3 if i % 7 == 0 else 4] / 2
            ring = box @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]]) + g.random(2) * 3
            pair.append([tuple(map(float, p)) for p in (ring if g.random() < 0.5 else ring[::-1])])
        rows.append(tuple(pair))
    df = spark.createDataFrame(rows, KIND)
    far = df.select(*[F.transform(x, lambda p: F.struct((p["x"] + 6e5).alias("x"), (p["y"] + 4.1e6).alias("y"))).alias(x) for x in ("a", "b")])
    both = [[r[0] for r in d.select(polygons.ring_area(polygons.overlap_ring(F.col("a"), F.col("b")))).collect()] for d in (df, far)]
    x, y = np.meshgrid(np.arange(-4, 8, 0.01) + 0.005, np.arange(-4, 8, 0.01) + 0.005)
    for (a, b), got, away in zip(rows, *both):
        assert abs(got - (inside(a, x, y) & inside(b, x, y)).sum() * 1e-4) < 0.02 and abs(got - away) < 1e-6


def test_edges_of_rings(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    flat, off, touch = [(0.0, 0.0), (2.0, 0.0), (1.0, 0.0)], [(9.0, 9.0), (10.0, 9.0), (9.0, 10.0)], [(2.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0)]
    df = spark.createDataFrame([(square, square), (square, square[::-1]), (square, flat), (flat, square), (square, off), (square, touch), (square, []), ([], square), (square, None)], KIND)
    out = [r[0] for r in df.select(polygons.ring_area(polygons.overlap_ring(F.col("a"), F.col("b")))).collect()]
    assert out[:8] == [4.0, 4.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0] and not out[8]
    a = spark.createDataFrame([(1, 5, square), (2, None, square), (3, 5, None), (4, 5, flat)], f"det_id long, image long, ring {polygons.RING}")
    pairs = polygons.footprint_pairs(a, a.withColumnRenamed("det_id", "gt_id"), 0.1).collect()
    assert [tuple(p) for p in pairs] == [(1, 1, 4.0, 1.0)]


def test_a_pair_is_clipped_once(spark):
    """No filter or join condition clips; pairs whose boxes overlap too little for ``least`` go before, those at it stay."""
    square = [(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (0.0, 1.0)]
    a = spark.createDataFrame([(1, 5, square)], f"det_id long, image long, ring {polygons.RING}")
    b = spark.createDataFrame([(k, 5, [(x + k, y) for x, y in square]) for k in (0, 1, 2, 3)], f"gt_id long, image long, ring {polygons.RING}")
    out = polygons.footprint_pairs(a, b, 0.5)
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if "flatten(" in x and ("Filter" in x or "Join" in x)] and sum(x.count("flatten(") for x in plan) == 1
    assert sorted(map(tuple, out.collect())) == [(1, 0, 3.0, 1.0), (1, 1, 2.0, 0.5)]
