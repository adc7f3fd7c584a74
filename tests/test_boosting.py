"""Boosted trees against a recursion in NumPy, against the forest, and with odd tables."""

import random

import numpy as np
import pytest

from seasight.operators import boosting, classifier


def table(spark, n=1500, seed=3):
    """Three classes of very different sizes, two of which only a and b together tell apart: inside and outside a circle."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, noise = r.uniform(-1, 1), r.uniform(-1, 1), r.gauss(0, 1)
        k = "far" if i % 14 == 0 else "inside" if a * a + b * b < 0.6 else "outside"
        rows.append((i, k, a + (3 if k == "far" else 0), None if i % 13 == 0 else b, float("nan") if i % 7 == 0 else noise))
    return spark.createDataFrame(rows, "id long, label string, a double, b double, noise double")


FEATURES = ["a", "b", "noise"]


def best_split(bins, g, h, penalty):
    found = (0.0, -1, -1, True)
    worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + penalty)
    for j in range(bins.shape[1]):
        for missing_left in (True, False):
            for v in range(1, 70):
                left = np.where(bins[:, j] == 0, missing_left, bins[:, j] <= v)
                if min(left.sum(), (~left).sum()) < boosting.LEAST_ROWS or min(h[left].sum(), h[~left].sum()) < boosting.LEAST_CURVATURE:
                    continue
                gain = worth(left) + worth(~left) - worth(np.ones(len(g), bool))
                if gain > found[0] + 1e-9:
                    found = (gain, j, v, missing_left)
    return found


def grown(bins, g, h, depth, rate, penalty):
    """What every row gets from one tree."""
    out = np.full(len(g), -rate * g.sum() / (h.sum() + penalty))
    if depth:
        gain, j, v, missing_left = best_split(bins, g, h, penalty)
        if gain > 0:
            left = np.where(bins[:, j] == 0, missing_left, bins[:, j] <= v)
            for side in (left, ~left):
                out[side] = grown(bins[side], g[side], h[side], depth - 1, rate, penalty)
    return out


def test_rounds_are_those_of_a_recursion(spark):
    d = table(spark, 400).repartition(5)
    m = boosting.fit(d, FEATURES, rounds=3, rate=0.3, depth=2, bins=16, held_out=0)
    pdf = d.toPandas()
    bins = boosting._bins(m.edges, pdf[FEATURES].to_numpy(dtype=float))
    y = pdf["label"].map(m.classes.index).to_numpy()
    w = (len(y) / (len(m.classes) * np.bincount(y)))[y]
    scores = np.zeros((len(y), len(m.classes)))
    for _ in range(3):
        p = boosting._softmax(scores)
        scores = scores + np.stack([grown(bins, w * (p[:, k] - (y == k)), w * p[:, k] * (1 - p[:, k]), 2, 0.3, 1.0) for k in range(len(m.classes))], axis=1)
    got = {r["id"]: r["proba"] for r in boosting.predict(m, d).collect()}
    assert np.allclose([got[i] for i in pdf["id"]], boosting._softmax(scores), atol=1e-9)


def macro_f1(model, d):
    n = {(r["truth"], r["pred"]): r["n"] for r in classifier.confusion_counts(model, d).collect()}
    f1 = []
    for k in classifier.classes_of(model):
        tp = n.get((k, k), 0)
        f1.append(2 * tp / (sum(v for (t, _), v in n.items() if t == k) + sum(v for (_, p), v in n.items() if p == k)))
    return sum(f1) / len(f1)


def test_as_good_as_the_forest_and_saved(spark, tmp_path):
    d = table(spark)
    train, rest = d.filter("id % 3 <> 1"), d.filter("id % 3 = 1")
    m = boosting.fit(train, FEATURES, rounds=12, rate=0.4, depth=3, patience=4)
    assert macro_f1(m, rest) >= max(0.9, macro_f1(classifier.fit(train, FEATURES, trees=12, depth=3), rest))
    assert m.losses[-1] < m.losses[0] == pytest.approx(np.log(3))
    assert {f for f, _ in classifier.importances(m)[:2]} == {"a", "b"} and sum(v for _, v in classifier.importances(m)) == pytest.approx(1)
    assert classifier.probability(m, rest, "far").filter("probability > 0.5 and label = 'far'").count() > 25
    boosting.save(m, spark, f"file://{tmp_path}/m")
    again = boosting.load(spark, f"file://{tmp_path}/m", FEATURES)
    said = lambda x: boosting.predict(x, rest).select("id", "predicted", "proba").orderBy("id").collect()
    assert said(again) == said(m)
    with pytest.raises(ValueError):
        boosting.load(spark, f"file://{tmp_path}/m", FEATURES[::-1])
    with pytest.raises(ValueError):
        classifier.predict(m, d.drop("b"))


def test_rounds_end_when_nothing_is_learned(spark):
    r = random.Random(5)
    d = spark.createDataFrame([(r.choice("xy"), r.random()) for _ in range(600)], "label string, a double")
    m = boosting.fit(d, ["a"], rounds=30, rate=0.5, depth=2, held_out=4, patience=2)
    assert len(m.rounds) < 10 and len(m.losses) < 15


def test_odd_tables(spark):
    d = spark.createDataFrame([("p", None, 1, "k")] * 50 + [("q", float("inf"), 2, "k")] * 50 + [(None, 1.0, 3, "k")], "label string, x double, proba int, y string")
    m = boosting.fit(d, ["x"], rounds=2, held_out=0, depth=1, rate=1.0)
    out = boosting.predict(m, d).select("label", "predicted", "y").distinct().collect()
    assert {(r["label"], r["predicted"]) for r in out if r["label"]} == {("p", "p"), ("q", "q")}
    one = boosting.fit(d.filter("label = 'p'"), ["x"], rounds=2)
    assert one.rounds == [] and boosting.predict(one, d).filter("predicted <> 'p' or proba[0] <> 1").isEmpty()
    assert boosting.predict(m, d.limit(0)).collect() == []
    with pytest.raises(ValueError):
        boosting.fit(d.limit(0), ["x"])
