"""Gradient-boosted trees for several classes: a tree per class and round, on bins that all trees share.

A level of all the round's trees is one job: tasks add up gradients by (class,
node, feature, bin), a shuffle by (class, node, feature) adds the tasks' sums,
and a row per key, its best split, comes to the driver. Rows never move.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seasight.lineage import keep

#: A split leaves at least as many rows, and as much curvature, on either side.
LEAST_ROWS, LEAST_CURVATURE = 20, 1e-3
#: Rounds between two writings of the rows' scores; the trees since then are applied anew in each job.
_EVERY = 5
_SPLIT = "k int, node int, feature int, gain double, bin int, missing_left boolean, g double, h double, gl double, hl double"


@dataclass
class Trees:
    """A round's trees, one per class, as full trees: node i has children 2 i + 1 and 2 i + 2; a node without a feature sends all to the left."""

    feature: np.ndarray  # class, inner node; -1: none
    bin: np.ndarray  # class, inner node; values up to this bin go left
    missing_left: np.ndarray
    value: np.ndarray  # class, leaf

    def nodes(self, bins: np.ndarray, k: int, levels: int) -> np.ndarray:
        """The node that each row of ``bins`` reaches in class ``k``'s tree after so many levels."""
        at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[k][at]
            b = bins[rows, np.maximum(f, 0)]
            right = (f >= 0) & np.where(b == 0, ~self.missing_left[k][at], b > self.bin[k][at])
            at = 2 * at + 1 + right
        return at

    def add(self, bins: np.ndarray, scores: np.ndarray) -> None:
        depth = self.value.shape[1].bit_length() - 1
        for k in range(len(self.value)):
            scores[:, k] += self.value[k][self.nodes(bins, k, depth) - (2**depth - 1)]


@dataclass
class Boosted:
    """A fitted model: bounded by rounds x classes x 2^depth, whatever the table."""

    features: list[str]
    classes: list[str]
    edges: list[np.ndarray]
    start: np.ndarray
    rounds: list[Trees] = field(default_factory=list)
    gains: np.ndarray | None = None
    losses: list[float] = field(default_factory=list)


def _bins(edges: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """0 where there is no value, else one more than the edges below it."""
    out = np.empty(values.shape, dtype=np.uint8)
    for j, e in enumerate(edges):
        v = values[:, j]
        out[:, j] = np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v, side="left"))
    return out


def _matrix(column: pd.Series, width: int, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=dtype).reshape(len(column), width)


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _values(features: list[str]):
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])


def _need(df: DataFrame, features: list[str]) -> None:
    missing = set(features) - set(df.columns)
    if missing:
        raise ValueError(f"missing features: {', '.join(sorted(missing))}")


def _prepared(d: DataFrame, model: Boosted, held_out: int) -> DataFrame:
    """Rows as bytes of bins, class, weight, whether they only judge, and scores; equal rows of a class judge or teach together."""
    edges, start = model.edges, model.start.tobytes()

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            b = _bins(edges, np.array(f["x"].tolist(), dtype=float).reshape(len(f), len(edges)))
            yield pd.DataFrame({"bins": [r.tobytes() for r in b], "y": f["y"], "w": f["w"], "scores": [start] * len(f)})

    out = d.mapInPandas(rows, "bins binary, y int, w double, scores binary")
    judges = F.pmod(F.xxhash64("bins", "y"), F.lit(held_out)) == 0 if held_out else F.lit(False)
    return keep(out.withColumn("judges", judges))


def _advance(d: DataFrame, recent: list[Trees], n_features: int, n_classes: int) -> DataFrame:
    """The rows with their scores brought up to date, written."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = _matrix(f["scores"], n_classes, float).copy()
            b = _matrix(f["bins"], n_features, np.uint8)
            for t in recent:
                t.add(b, s)
            yield f.assign(scores=[r.tobytes() for r in s])

    return keep(d.mapInPandas(rows, d.schema))


def _sums(recent: list[Trees], growing: Trees, level: int, n_features: int, n_classes: int, n_bins: int):
    """A task's sums: a row per (class, node, feature) that it has rows of, and its part of the judging rows' loss as class -1."""
    first, wide = 2**level - 1, 2**level

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_classes, n_features, wide * n_bins, 3))
        loss = np.zeros(3)
        for f in frames:
            b = _matrix(f["bins"], n_features, np.uint8)
            s = _matrix(f["scores"], n_classes, float).copy()
            for t in recent:
                t.add(b, s)
            p, y, w = _softmax(s), f["y"].to_numpy(), f["w"].to_numpy()
            judges = f["judges"].to_numpy(dtype=bool)
            own = np.maximum(p[judges, y[judges]], 1e-15)
            loss += [-(w[judges] * np.log(own)).sum(), w[judges].sum(), judges.sum()]
            b, p, y, w = b[~judges], p[~judges], y[~judges], w[~judges]
            for k in range(n_classes):
                node = growing.nodes(b, k, level) - first
                g, h = w * (p[:, k] - (y == k)), w * p[:, k] * (1 - p[:, k])
                for j in range(n_features):
                    at = node * n_bins + b[:, j]
                    for c, v in enumerate((g, h, None)):
                        total[k, j, :, c] += np.bincount(at, v, wide * n_bins)
        by_node = total.reshape(n_classes, n_features, wide, n_bins, 3)
        k, j, node = np.nonzero(by_node[..., 2].sum(axis=3))
        out = [(int(a), int(n), int(c), by_node[a, c, n].tobytes()) for a, c, n in zip(k, j, node)]
        yield pd.DataFrame([*out, (-1, 0, 0, loss.tobytes())], columns=["k", "node", "feature", "sums"])

    return rows


def _best_split(k: int, node: int, j: int, s: np.ndarray, penalty: float) -> tuple:
    """Of one (class, node, feature) the split of most gain, missing values left or right; no split has gain 0."""
    if k < 0:
        return k, node, j, 0.0, -1, True, s[0], s[1], 0.0, 0.0
    s = s.reshape(-1, 3)
    (g, h, n), best = s.sum(axis=0), (0.0, -1, True, 0.0, 0.0)
    value = lambda a, b: a * a / (b + penalty + 1e-300)
    for missing_left in (True, False):
        gl, hl, nl = (np.cumsum(s[1:], axis=0) + (s[0] if missing_left else 0)).T
        gr, hr, nr = g - gl, h - hl, n - nl
        fine = (np.minimum(nl, nr) >= LEAST_ROWS) & (np.minimum(hl, hr) >= LEAST_CURVATURE)
        gain = np.where(fine, value(gl, hl) + value(gr, hr) - value(g, h), 0.0)
        at = int(gain.argmax())
        if gain[at] > best[0] + 1e-12:
            best = (float(gain[at]), at + 1, missing_left, float(gl[at]), float(hl[at]))
    gain, at, missing_left, gl, hl = best
    return k, node, j, gain, at, missing_left, g, h, gl, hl


def _best(penalty: float):
    """Adds up the tasks' sums, which come key by key, and in the order of their bytes, so that a rerun adds up alike."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        for f in frames:
            out = []
            for k, node, j, sums in f.itertuples(index=False, name=None):
                if (k, node, j) != key:
                    if key:
                        out.append(_best_split(*key, total, penalty))
                    key, total = (k, node, j), 0.0
                total = total + np.frombuffer(sums)
            yield pd.DataFrame(out, columns=_COLUMNS)
        if key:
            yield pd.DataFrame([_best_split(*key, total, penalty)], columns=_COLUMNS)

    return rows


_COLUMNS = [c.split()[0] for c in _SPLIT.split(", ")]


def _grow(d: DataFrame, model: Boosted, recent: list[Trees], depth: int, rate: float, penalty: float, n_bins: int) -> tuple[Trees, float]:
    """One round's trees, level by level, and the judging rows' mean loss before it."""
    n, m = len(model.classes), len(model.features)
    inner, leaves = 2**depth - 1, 2**depth
    t = Trees(np.full((n, inner), -1), np.zeros((n, inner), dtype=int), np.ones((n, inner), dtype=bool), np.zeros((n, leaves)))
    worth = np.zeros((n, 2 * inner + 1))
    mean_loss = float("nan")
    for level in range(depth):
        sums = d.mapInPandas(_sums(recent, t, level, m, n, n_bins), "k int, node int, feature int, sums binary")
        keys = ["k", "node", "feature"]
        found = sums.repartition(*keys).sortWithinPartitions(*keys, "sums").mapInPandas(_best(penalty), _SPLIT)
        # Of a node the feature of most gain, then the first: a row per class and node comes to the driver.
        top = found.groupBy("k", "node").agg(F.max_by(F.struct(*_COLUMNS), F.struct("gain", -F.col("feature"))).alias("s")).select("s.*").collect()
        for s in top:
            if s["k"] < 0:
                mean_loss = s["g"] / s["h"] if level == 0 and s["h"] else mean_loss
                continue
            k, at = s["k"], 2**level - 1 + s["node"]
            step = lambda g, h: -rate * g / (h + penalty) if h + penalty > 0 else 0.0
            worth[k, at] = step(s["g"], s["h"])
            # What isn't split goes on to the left, and is worth there what it is here.
            worth[k, 2 * at + 1] = worth[k, at]
            if s["gain"] > 0:
                t.feature[k, at], t.bin[k, at], t.missing_left[k, at] = s["feature"], s["bin"], s["missing_left"]
                worth[k, 2 * at + 1] = step(s["gl"], s["hl"])
                worth[k, 2 * at + 2] = step(s["g"] - s["gl"], s["h"] - s["hl"])
                model.gains[s["feature"]] += s["gain"]
    t.value = worth[:, inner:]
    return t, mean_loss


def fit(
    df: DataFrame,
    features: list[str],
    label: str = "label",
    rounds: int = 300,
    rate: float = 0.1,
    depth: int = 5,
    bins: int = 64,
    penalty: float = 1.0,
    held_out: int = 10,
    patience: int = 10,
) -> Boosted:
    """Learns from all rows with a label; a class weighs as much as any other, however many rows it has.

    Values are put in at most ``bins`` bins by their quantiles; null and NaN are
    a bin of their own, which each split sends where it gains more. One row in
    ``held_out`` (0: none) only judges: when its loss hasn't fallen for
    ``patience`` rounds, no more are added and those after the best go. Repeated
    rows count as often as they stand. A table without labels raises; columns
    beside the features and the label are not read.
    """
    _need(df, features)
    if not 2 <= bins <= 250:
        raise ValueError("bins must be 2 to 250")
    d = df.filter(F.col(label).isNotNull()).select(_values(features).alias("x"), F.col(label).cast("string").alias("label"))
    sizes = d.groupBy("label").agg(F.count("*").alias("n"))  # a row per class
    every = Window.partitionBy(F.lit(1))
    order = Window.orderBy("label")
    sizes = sizes.select("label", (F.row_number().over(order) - 1).alias("y"), (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("w"))
    classes = [r["label"] for r in sizes.orderBy("y").collect()]
    if not classes:
        raise ValueError("no row has a label")
    quantiles = df.filter(F.col(label).isNotNull()).select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    found = quantiles.approxQuantile(quantiles.columns, [i / bins for i in range(1, bins)], 0.1 / bins)
    edges = [np.unique([v for v in q if np.isfinite(v)]) for q in found]
    model = Boosted(list(features), classes, edges, np.zeros(len(classes)), gains=np.zeros(len(features)))
    d = _prepared(d.join(F.broadcast(sizes), "label").select("x", "y", "w"), model, held_out)
    n_bins = 2 + max(len(e) for e in edges)
    recent: list[Trees] = []
    best, best_at = float("inf"), 0
    for r in range(rounds if len(classes) > 1 else 0):
        if len(recent) == _EVERY:
            d, recent = _advance(d, recent, len(features), len(classes)), []
        trees, loss = _grow(d, model, recent, depth, rate, penalty, n_bins)
        model.losses.append(loss)
        if loss < best - 1e-7:
            best, best_at = loss, r
        elif held_out and loss == loss and r - best_at >= patience:
            model.rounds = model.rounds[:best_at]
            break
        model.rounds.append(trees)
        recent = [*recent, trees]
        if (trees.feature < 0).all():
            break
    return model


def predict(model: Boosted, df: DataFrame) -> DataFrame:
    """``df`` with predicted (of equals the first class) and proba (an array in the order of ``classes``); columns of these names are replaced."""
    _need(df, model.features)
    edges, rounds, start = model.edges, model.rounds, model.start

    @F.pandas_udf("array<double>")
    def proba(values: pd.Series) -> pd.Series:
        b = _bins(edges, np.array(values.tolist(), dtype=float).reshape(len(values), len(edges)))
        s = np.tile(start, (len(b), 1))
        for t in rounds:
            t.add(b, s)
        return pd.Series(list(_softmax(s)))

    names = F.array(*[F.lit(c) for c in model.classes])
    out = df.withColumn("proba", proba(_values(model.features)))
    return out.withColumn("predicted", F.get(names, (F.array_position("proba", F.array_max("proba")) - 1).cast("int")))


def importances(model: Boosted) -> list[tuple[str, float]]:
    """Features with their share of all splits' gain, the most informative first."""
    total = model.gains.sum() or 1.0
    return sorted(zip(model.features, (model.gains / total).tolist()), key=lambda x: (-x[1], x[0]))


def save(model: Boosted, spark: SparkSession, path: str) -> None:
    """The model as JSON, which holds numbers and names only."""
    text = {
        "features": model.features,
        "classes": model.classes,
        "edges": [e.tolist() for e in model.edges],
        "start": model.start.tolist(),
        "gains": model.gains.tolist(),
        "losses": [None if x != x else x for x in model.losses],
        "rounds": [{k: getattr(t, k).tolist() for k in ("feature", "bin", "missing_left", "value")} for t in model.rounds],
    }
    spark.createDataFrame([(json.dumps(text),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str, features: list[str]) -> Boosted:
    """The saved model; one of other features raises."""
    m = json.loads(spark.read.text(path).first()["value"])
    if m["features"] != list(features):
        raise ValueError("the model was fitted on other features")
    rounds = [Trees(np.array(t["feature"]), np.array(t["bin"]), np.array(t["missing_left"], dtype=bool), np.array(t["value"])) for t in m["rounds"]]
    losses = [float("nan") if x is None else x for x in m["losses"]]
    return Boosted(m["features"], m["classes"], [np.array(e) for e in m["edges"]], np.array(m["start"]), rounds, np.array(m["gains"]), losses)
