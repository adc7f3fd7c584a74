"""Curves whose scores all lie in one band: right, and with work that grows as the rows do."""

import random

import pytest

from seasight.operators import detections


def tables(spark, n=300):
    r = random.Random(8)
    flags = [r.random() < 0.6 for _ in range(n)]
    d = [(i, 0, "a", 10.0 * i, 0.0, 10.0 * i + 8, 8.0, 0.5) for i in range(n)]
    g = [(i, 0, "a", 10.0 * i, 0.0, 10.0 * i + 8, 8.0) for i in range(n) if flags[i]]
    of = "{} long, image long, label string, xmin double, ymin double, xmax double, ymax double"
    return flags, spark.createDataFrame(d, of.format("det_id") + ", score double"), spark.createDataFrame(g, of.format("gt_id"))


def envelope(flags):
    tp, precision, out, best = 0, [], [], 0.0
    for i, f in enumerate(flags, 1):
        tp += f
        precision.append(tp / i)
    for p in reversed(precision):
        best = max(best, p)
        out.append(best)
    return out[::-1]


def shrinks(df):
    """Whether a window's frame ends with its partition: such a frame is computed anew for every row."""
    return "UnboundedFollowing" in df._jdf.queryExecution().optimizedPlan().toString().replace("unboundedfollowing$()", "UnboundedFollowing")


def test_the_sweeps_frames_grow(spark):
    flags, d, g = tables(spark)
    out = detections.sweep(d, g)
    want = sum(e for e, f in zip(envelope(flags), flags) if f) / sum(flags)
    assert not shrinks(out) and {(r["threshold"], round(r["ap"], 9)) for r in out.collect()} == {(t, round(want, 9)) for t in detections.THRESHOLDS}


def test_the_sweep_keeps_its_pairs_before_it_repeats_them_by_threshold(spark, monkeypatch):
    _, d, g = tables(spark, 20)
    own, seen = detections.greedy, []
    monkeypatch.setattr(detections, "greedy", lambda pairs, keys=(): seen.append(pairs) or own(pairs, keys))
    detections.sweep(d, g)
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString() and seen[0].count() == 10 * g.count()


def curve(spark):
    flags, d, g = tables(spark)
    return flags, d, g, detections.pr_curve(d, g, detections.match(d, g))


def test_the_curves_frames_grow(spark):
    flags, _, _, out = curve(spark)
    assert not shrinks(out) and [r["envelope"] for r in out.orderBy("rank").collect()] == envelope(flags)


def test_average_precision_and_the_evaluation_by_such_frames(spark):
    flags, d, g, c = curve(spark)
    want = sum(e for e, f in zip(envelope(flags), flags) if f) / sum(flags)
    for out in (detections.average_precision(c), detections.evaluate(d, g).filter("label = 'a'")):
        assert not shrinks(out) and out.first()["ap"] == pytest.approx(want)
