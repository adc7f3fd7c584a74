"""Chips among candidate windows: counts by squares and the choice against loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasight.operators import patches

KIND = "image long, r long, c long, scl int, v double"


def brute(scene, size, stride, least_water, least):
    """{(r0, c0): (n, n_wanted, reason)} and the greedy choice, of one scene {(r, c): (scl, v)}."""
    out = {}
    rs, cs = [p[0] for p in scene], [p[1] for p in scene]
    for r0 in range((min(rs) - size) // stride * stride, max(rs) + 1, stride):
        for c0 in range((min(cs) - size) // stride * stride, max(cs) + 1, stride):
            p = [scene[r, c] for r in range(r0, r0 + size) for c in range(c0, c0 + size) if (r, c) in scene]
            if not p:
                continue
            n, share = len(p), lambda f: sum(map(f, p)) / len(p)  # noqa: B023
            wanted = sum(x[1] is not None and x[1] > 0.6 for x in p)
            tests = [("outside the scene", n < size * size), ("no data", share(lambda x: x[1] is None) > 0.02), ("too little water", share(lambda x: x[0] == 6) < least_water), ("cloud", share(lambda x: x[0] in (8, 9, 10)) > 0.3), ("too few wanted pixels", wanted < least)]
            out[r0, c0] = (n, wanted, next((k for k, bad in tests if bad), None))
    took = []
    for _, r, c in sorted((-w, *at) for at, (_, w, why) in out.items() if why is None):
        if all(abs(r - y) >= size or abs(c - x) >= size for y, x in took):
            took.append((r, c))
    return out, set(took)


def test_chips_are_those_of_loops(spark):
    """Two scenes, one of NULL, with holes, clouds, ties, places below zero and rows without a place."""
    g = np.random.default_rng(4)
    scenes, rows = {}, [(1, None, 3, 6, 0.9), (1, 3, None, 6, 0.9)]
    for image, (h, w) in {1: (26, 33), None: (17, 14)}.items():
        s = scenes[image] = {}
        for r in range(-3, h):
            for c in range(w):
                if (r, c) != (20, 20):
                    cloud = 8 <= r < 16 and c < 6
                    s[r, c] = (9 if cloud else 6 if g.random() < 0.97 else 4, None if (r, c) in ((2, 30), (3, 31)) else round(float(g.random()), 1))
        rows += [(image, *at, *v) for at, v in s.items()]
    px = spark.createDataFrame(rows, KIND)
    w = patches.chip_windows(px, 6, 3, F.col("v") > 0.6, F.col("v").isNull(), 0.6, 9)
    got = patches.choose_chips(w.withColumn("rank", F.lit(1)).union(w.withColumn("rank", F.lit(1))), 6).collect()
    assert len(got) == len({(x["image"], x["r0"], x["c0"]) for x in got})
    reasons = set()
    for image, s in scenes.items():
        want, took = brute(s, 6, 3, 0.6, 9)
        mine = {(x["r0"], x["c0"]): x for x in got if x["image"] == image}
        assert {k: (x["n_pixels"], x["n_wanted"]) for k, x in mine.items()} == {k: v[:2] for k, v in want.items()}
        assert {k for k, x in mine.items() if x["chosen"]} == took and took
        for k, x in mine.items():
            assert x["reason"] == (want[k][2] or (None if k in took else "overlaps a better chip"))
            reasons.add(x["reason"])
    assert {"outside the scene", "no data", "too few wanted pixels", "overlaps a better chip", None} <= reasons


def test_no_chips(spark):
    empty = spark.createDataFrame([], KIND)
    w = patches.chip_windows(empty, 4, 2, F.col("v") > 0, F.col("v").isNull(), 0.5)
    assert w.count() == 0 and patches.choose_chips(w, 4).count() == 0
    with pytest.raises(ValueError):
        patches.chip_windows(empty, 5, 2, F.col("v") > 0, F.col("v").isNull(), 0.5)
