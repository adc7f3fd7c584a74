"""Areas and fronts of the coast against brute force, and pairs of boxes of any sizes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasight.functions import geo
from seasight.operators import catalog, coastal, curves, detections
from seasight.operators.pairs import box_pairs

SEGS = "seg_id long, image long, x0 double, y0 double, x1 double, y1 double"
BOXES = "det_id long, image long, label string, xmin double, ymin double, xmax double, ymax double, score double"


def strips(boxes, edges, reach, each=1500):
    """The area by the stretches that many thin strips have of both; strips end at the boxes' sides."""
    ends = np.array([edges[:, [0, 2]].min() - reach, edges[:, [0, 2]].max() + reach])
    sides = np.unique(np.clip(np.array([[b[0], b[2]] for b in boxes]).ravel(), *ends))
    x = (sides[:-1, None] + np.diff(sides)[:, None] * (np.arange(each) + 0.5) / each).ravel()
    wide, n = np.repeat(np.diff(sides) / each, each), (len(sides) - 1) * each
    spans = []
    for x0, y0, x1, y1 in edges:
        # the zone of an edge as the hull of its circles: highest and lowest of many points of the edge
        t = np.linspace(0, 1, 801)
        top, low = np.full(n, -np.inf), np.full(n, np.inf)
        for s in t:
            rest = reach**2 - (x - x0 - s * (x1 - x0)) ** 2
            ok, h = rest >= 0, np.sqrt(np.maximum(rest, 0))
            top, low = np.where(ok, np.maximum(top, y0 + s * (y1 - y0) + h), top), np.where(ok, np.minimum(low, y0 + s * (y1 - y0) - h), low)
        for a, l, b, h in boxes:
            inside = (x >= a) & (x <= b)
            spans.append((np.where(inside, np.maximum(low, l), 1.0), np.where(inside, np.minimum(top, h), 0.0)))
    low, high = np.stack([s[0] for s in spans]), np.stack([s[1] for s in spans])
    low, high = np.where(high > low, low, np.inf), np.where(high > low, high, -np.inf)
    order = np.argsort(low, axis=0)
    low, high = np.take_along_axis(low, order, 0), np.take_along_axis(high, order, 0)
    upto = np.maximum.accumulate(np.concatenate([np.full((1, n), -np.inf), high[:-1]]), axis=0)
    return float(np.where(high > low, np.maximum(high - np.maximum(low, upto), 0), 0).sum(axis=0) @ wide)


def test_area_is_that_of_thin_strips(spark):
    """Boxes from a metre to five kilometres over a bent coast with a point and an upright edge."""
    r = random.Random(4)
    edges = np.array([[0, 0, 70, 31], [70, 31, 70, 90], [70, 90, 70, 90], [70, 90, 20, 55]], float)
    boxes = [(x := r.uniform(-40, 100), y := r.uniform(-40, 120), x + r.uniform(1, 25), y + r.uniform(1, 25)) for _ in range(12)]
    boxes += [(-3000.3, 60.25, 2000.1, 61.5), (33.3, -2500.0, 34.05, 2500.0), boxes[0]]
    segs = spark.createDataFrame([(1, 0, *e) for e in edges.tolist()] * 2, SEGS)
    d = spark.createDataFrame([(i, 0, "a", *map(float, b), 0.5) for i, b in enumerate(boxes)], BOXES)
    got = coastal.union_area(d, segs, 18.0).first()["area"]
    assert got == pytest.approx(strips(boxes, edges, 18.0), rel=1e-4)
    whole = coastal.part_in_zone(-100, -100, 200, 200, edges, 18.0)
    assert coastal.zone_area(segs, 18.0).first()["zone_area"] == pytest.approx(whole, abs=1e-6)
    assert coastal.union_area(d.limit(1).withColumns({"xmin": F.lit(-5000.0), "ymin": F.lit(-5000.0), "xmax": F.lit(5000.0), "ymax": F.lit(5000.0)}), segs, 18.0).first()["area"] == pytest.approx(whole, abs=1e-6)


def test_areas_that_are_known(spark):
    """A circle, half of one, a stadium, two circles that overlap; small boxes as they are, at any offset."""
    at = lambda *e: np.array([e], float)
    assert coastal.part_in_zone(-30, -30, 30, 30, at(0, 0, 0, 0), 20.0) == pytest.approx(400 * math.pi, abs=1e-8)
    assert coastal.part_in_zone(0, -30, 30, 30, at(0, 0, 0, 0), 20.0) == pytest.approx(200 * math.pi, abs=1e-8)
    tilted = at(0, 0, 30, 40)
    assert coastal.part_in_zone(-90, -90, 90, 90, tilted, 20.0) == pytest.approx(400 * math.pi + 50 * 40, abs=1e-8)
    lens = 2 * 400 * math.acos(15 / 40) - 15 / 2 * math.sqrt(4 * 400 - 15**2)
    assert coastal.part_in_zone(-90, -90, 90, 90, np.array([[0, 0, 0, 0], [9, 12, 9, 12]], float), 20.0) == pytest.approx(800 * math.pi - lens, abs=1e-8)
    segs = spark.createDataFrame([(1, 0, 0.0, 0.0, 1000.0, 0.0)], SEGS)
    for off in (0.0, 3.3, 7.7):
        d = spark.createDataFrame([(i, 0, "a", 100.0 * i + off, -4.5, 100.0 * i + off + 9, 4.5, 0.5) for i in range(1, 6)], BOXES)
        assert coastal.union_area(d, segs).first()["area"] == pytest.approx(405, abs=1e-9)


def test_a_large_box_makes_few_rows(spark):
    segs = spark.createDataFrame([(1, 0, 0.0, 0.0, 1000.0, 0.0)], SEGS)
    d = spark.createDataFrame([(1, 0, "a", -2500.0, -3000.0, 3500.0, 3000.0, 0.5)], BOXES)
    met = coastal.meet(d, segs, 20.0)
    assert met.count() == 13  # the pieces of the edge
    assert coastal.union_area(d, segs, met=met).first()["area"] == pytest.approx(40_000 + 400 * math.pi, abs=1e-6)
    assert coastal.front(d, segs, met=met).first()["front"] == pytest.approx(1000, abs=1e-9)


def test_front_is_that_of_many_points(spark):
    r = random.Random(6)
    edges = [(0.0, 0.0, 300.0, 100.0), (300.0, 100.0, 300.0, 100.0), (300.0, 100.0, 300.0, 0.0), (300.0, 0.0, 100.0, 0.0)]
    boxes = [(x := r.uniform(-40, 330), y := r.uniform(-40, 140), x + r.uniform(0, 20), y + r.uniform(0, 20)) for _ in range(15)]
    want = 0.0
    for x0, y0, x1, y1 in edges:
        t = (np.arange(200_000) + 0.5) / 200_000
        x, y = x0 + t * (x1 - x0), y0 + t * (y1 - y0)
        near = np.zeros(len(t), bool)
        for a, l, b, h in boxes:
            near |= np.hypot(np.maximum(np.maximum(a - x, x - b), 0), np.maximum(np.maximum(l - y, y - h), 0)) <= 20
        want += near.mean() * math.hypot(x1 - x0, y1 - y0)
    segs = spark.createDataFrame([(1, 0, *e) for e in edges], SEGS)
    d = spark.createDataFrame([(i, 0, "a", *b, 0.5) for i, b in enumerate(boxes)], BOXES)
    assert coastal.front(d, segs).first()["front"] == pytest.approx(want, abs=0.02)


def test_pairs_of_any_sizes_are_all_pairs(spark):
    """Boxes from none to 10,000 a side, also touching and at negative places; few rows, each pair once."""
    r = random.Random(8)

    def some(n):
        out = []
        for i in range(n):
            s = 10 ** r.uniform(-1, 4)
            x, y = r.choice([r.uniform(-5000, 5000), 16.0 * r.randrange(-20, 20)]), r.uniform(-5000, 5000)
            out.append((i, i % 2, x, y, x + r.choice([s, 16.0, 0.0]), y + s * r.uniform(0, 1)))
        return out

    a, b = some(150), some(150)
    p = spark.createDataFrame(a, "i long, k long, ax0 double, ay0 double, ax1 double, ay1 double")
    q = spark.createDataFrame(b, "j long, m long, bx0 double, by0 double, bx1 double, by1 double")
    got = [(x["i"], x["j"]) for x in box_pairs(p, q, {"k": "m"}, ("ax0", "ay0", "ax1", "ay1"), ("bx0", "by0", "bx1", "by1"), 16.0).collect()]
    want = [(u[0], v[0]) for u in a for v in b if u[1] == v[1] and max(u[2], v[2]) <= min(u[4], v[4]) and max(u[3], v[3]) <= min(u[5], v[5])]
    assert sorted(got) == sorted(want)
    assert box_pairs(p.limit(0), q, {"k": "m"}, ("ax0", "ay0", "ax1", "ay1"), ("bx0", "by0", "bx1", "by1"), 16.0).count() == 0


def test_matching_from_one_to_ten_thousand_pixels(spark):
    """Suppression and matching over boxes of very different sizes, by the loops that define them."""
    r = random.Random(9)

    def some(n, key):
        rows = []
        for i in range(n):
            s = 10 ** r.choice([0.0, 1.0, 2.0, 4.0])
            x, y = r.choice([0, 1, 2]) * s / 8, r.choice([0, 1]) * s / 8
            rows.append((i, 0, "a", x, y, x + s, y + s, r.randrange(20) / 20))
        return rows, spark.createDataFrame(rows, BOXES.replace("det_id", key))

    def iou(u, v):
        w, h = min(u[5], v[5]) - max(u[3], v[3]), min(u[6], v[6]) - max(u[4], v[4])
        both = max(w, 0) * max(h, 0)
        return both / ((u[5] - u[3]) * (u[6] - u[4]) + (v[5] - v[3]) * (v[6] - v[4]) - both)

    dets, d = some(60, "det_id")
    gts, g = some(40, "gt_id")
    kept = []
    for u in sorted(dets, key=lambda x: (-x[7], x[0])):
        if all(iou(u, v) <= 0.5 for v in kept):
            kept.append(u)
    assert sorted(x["det_id"] for x in detections.nms(d).collect()) == sorted(u[0] for u in kept)
    free, pairs = {v[0]: v for v in gts}, []
    for u in sorted(dets, key=lambda x: (-x[7], x[0])):
        best = max(((iou(u, v), -k) for k, v in free.items()), default=(0, 0))
        if best[0] >= 0.5:
            pairs.append((u[0], -best[1]))
            del free[-best[1]]
    assert sorted((x["det_id"], x["gt_id"]) for x in detections.match(d, g.drop("score")).collect()) == sorted(pairs)


def test_boxes_without_a_place_are_left_out(spark):
    segs = spark.createDataFrame([(1, 0, 0.0, 0.0, 1000.0, 0.0)], SEGS)
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, "a", 100.0, 0.0, 110.0, 5.0, 0.5), (2, 0, "a", nan, 0.0, 110.0, 5.0, 0.5), (3, 0, "a", 100.0, -inf, 110.0, 5.0, 0.5), (4, 0, "a", 100.0, 0.0, None, 5.0, 0.5)]
    d = spark.createDataFrame(rows, BOXES)
    assert coastal.near(d, segs).count() == 1 and coastal.union_area(d, segs).first()["area"] == 50
    assert d.filter("det_id = 1").select(geo.centre_size(200, 100).alias("b")).first()["b"] == [0.525, 0.025, 0.05, 0.05]


def test_search_over_the_date_line(spark):
    boxes = {"a": (170.0, 175.0), "b": (179.0, -179.0), "c": (-178.0, -170.0), "d": (0.0, 10.0), "e": (-175.0, 178.5)}
    s = spark.createDataFrame([(k, "2024-01-01", 0.0, w, -1.0, e, 1.0) for k, (w, e) in boxes.items()], "scene_id string, day string, cloud double, west double, south double, east double, north double")

    def found(west, east):
        return {r["scene_id"] for r in catalog.search(s, west, -5, east, 5, "2024-01-01", "2024-12-31", 50, 10).collect()}

    assert found(174, -177) == {"a", "b", "c", "e"} and found(179.5, -179.5) == {"b"}
    assert found(-180, -179.5) == {"b"} and found(5, 20) == {"d", "e"}


def test_debris_metrics(spark):
    n = spark.createDataFrame([("Marine Debris", "Marine Debris", 3), ("Marine Debris", "Ship", 1), ("Ship", "Marine Debris", 2), ("Ship", "Ship", 9)], "truth string, pred string, n long")
    r = curves.debris_metrics(n).first()
    assert (r["support"], r["precision"], r["recall"]) == (4, 0.6, 0.75)
