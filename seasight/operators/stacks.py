"""Bands of different pixel sizes on one grid, as stretches of rows.

A target's rows are made in blocks, each from the source rows that it needs, so
that what is shuffled is stretches of rows and not pixels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Target rows that a task makes at a time, and pixels of a stretch at most.
ROWS, STRETCH = 64, 1024
METHODS = ("nearest", "bilinear", "average", "mode")


def _mode(squares: np.ndarray) -> np.ndarray:
    """Of each row the most frequent value, the smaller of equally frequent ones; no data counts only where there is nothing else."""
    v = np.sort(squares, axis=1)  # no data last
    n = np.isfinite(v).sum(1)
    out, most = np.full(len(v), np.nan), np.zeros(len(v), int)
    run = np.zeros(len(v), int)
    for i in range(v.shape[1]):
        run = np.where((i > 0) & (v[:, i] == v[:, i - 1]), run + 1, 1)
        better = (i < n) & (run > most)
        out, most = np.where(better, v[:, i], out), np.where(better, run, most)
    return out


def _between(at: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pixels around places (in pixels, 0 the first's centre), and the share of the second; the outer ones are repeated."""
    at = np.clip(at, 0, last)
    low = np.minimum(np.floor(at).astype(int), last)
    return low, np.minimum(low + 1, last), at - low


def laid(src: np.ndarray, first: int, height: int, i0: int, i1: int, k: float, method: str) -> np.ndarray:
    """Target rows i0 to below i1 of a band whose rows from ``first`` on ``src`` holds; ``k`` is how many target pixels a source pixel is wide."""
    width = src.shape[1]
    if method in ("average", "mode"):
        by = max(1, round(1 / k))
        part = src[i0 * by - first : i1 * by - first]
        n2 = -(-width // by)
        full = np.full(((i1 - i0) * by, n2 * by), np.nan)
        full[: len(part), :width] = part
        squares = full.reshape(i1 - i0, by, n2, by).swapaxes(1, 2).reshape(-1, by * by)
        if method == "mode":
            return _mode(squares).reshape(i1 - i0, n2)
        good = np.isfinite(squares)
        n = good.sum(1)
        return np.where(n > 0, np.where(good, squares, 0).sum(1) / np.maximum(n, 1), np.nan).reshape(i1 - i0, n2)
    ys, xs = (np.arange(i0, i1) + 0.5) / k, (np.arange(int(np.ceil(width * k))) + 0.5) / k
    if method == "nearest":
        return src[np.minimum(ys.astype(int), height - 1) - first][:, np.minimum(xs.astype(int), width - 1)]
    y0, y1, wy = _between(ys - 0.5, height - 1)
    x0, x1, wx = _between(xs - 0.5, width - 1)
    good = np.isfinite(src)
    v, sums, weights = np.where(good, src, 0), 0.0, 0.0
    for y, wr in ((y0, 1 - wy), (y1, wy)):
        for x, wc in ((x0, 1 - wx), (x1, wx)):
            w = wr[:, None] * wc[None, :] * good[y - first][:, x]
            sums, weights = sums + w * v[y - first][:, x], weights + w
    return np.where(weights > 0, sums / np.where(weights > 0, weights, 1), np.nan)


def resample(rows: DataFrame, own: float, gsd: float, method: str = "bilinear", block: int = ROWS, most: int = STRETCH) -> DataFrame:
    """path, band, r, c0, values: bands whose pixels are ``own`` wide on a grid of pixels ``gsd`` wide that shares their corner.

    nearest takes the pixel under a new one's centre; bilinear weighs the four
    around it, those without data left out, and repeats the outer ones; average
    and mode are of the squares of pixels under a larger one (the ratio of sizes
    is rounded), and take the pixel itself where the new ones aren't larger. No
    data is NULL, and rows that are missing have none: a target row is NULL there, or missing too.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}, got {method}")
    k = own / gsd
    if method in ("average", "mode") and k >= 1:
        method = "nearest"
    c = F.col
    sizes = rows.groupBy("path", "band").agg((F.max("r") + 1).alias("height"), F.max(c("c0") + F.size("values")).alias("width"))  # a row per file and band
    d = rows.join(sizes, ["path", "band"])
    if method in ("average", "mode"):
        by = round(1 / k)
        lo = hi = F.floor(c("r") / by)
    else:
        more = 0.5 if method == "bilinear" else 0.0
        # the first and last rows stand for what is beyond them, too
        lo = F.when(c("r") == 0, 0).otherwise(F.floor((c("r") - more) * k))
        hi = F.ceil((c("r") + 1 + more) * k) - 1
    last = F.ceil(c("height") / by) - 1 if method in ("average", "mode") else F.ceil(c("height") * k) - 1
    lo, hi = (F.least(F.greatest(x, F.lit(0)), last).cast("long") for x in (lo, hi))
    d = d.withColumns({"last": last.cast("long"), "block": F.explode(F.sequence(F.floor(lo / block), F.floor(hi / block)))})

    def make(t: pa.Table) -> pa.Table:
        one = {x: t.column(x)[0].as_py() for x in ("path", "band", "block", "height", "width", "last")}
        r = t.column("r").to_numpy()
        first = int(r.min())
        i0, i1 = one["block"] * block, min(one["last"] + 1, (one["block"] + 1) * block)
        if method in ("average", "mode"):
            first = i0 * by
        src = np.full((int(r.max()) - first + 1, one["width"]), np.nan)
        for b in t.to_batches():
            for i, c0, v in zip(b.column("r").to_pylist(), b.column("c0").to_pylist(), b.column("values")):
                v = v.values.to_numpy(zero_copy_only=False)
                src[i - first, c0 : c0 + len(v)] = v
        if method not in ("average", "mode"):  # rows that are missing at the block's ends have no data
            above, under, _ = _between((np.array([i0, i1 - 1]) + 0.5) / k - 0.5, one["height"] - 1)
            top, low = max(0, first - int(above[0])), max(0, int(under[1]) - int(r.max()))
            src, first = np.pad(src, ((top, low), (0, 0)), constant_values=np.nan), first - top
        out = laid(src, first, one["height"], i0, i1, k, method)
        cuts = [(i0 + i, at, line[at : at + most]) for i, line in enumerate(out) for at in range(0, len(line), most)]
        n = len(cuts)
        values = pa.array([pa.array(v, from_pandas=True) for _, _, v in cuts], pa.list_(pa.float64()))
        return pa.table({"path": [one["path"]] * n, "band": [one["band"]] * n, "r": pa.array([x[0] for x in cuts], pa.int64()), "c0": pa.array([x[1] for x in cuts], pa.int64()), "values": values})

    kind = rows.schema["path"].dataType.simpleString()
    return d.select("path", "band", "block", "height", "width", "last", "r", "c0", "values").groupBy("path", "band", "block").applyInArrow(make, f"path {kind}, band string, r long, c0 long, values array<double>")


def stack(rows: DataFrame, sizes: dict[str, float], gsd: float, method: str = "bilinear", classes: tuple[str, ...] = ("SCL", "scl")) -> DataFrame:
    """path, band, r, c0, values: the bands of ``sizes`` (name: pixel size) on one grid; larger pixels by ``method``, smaller ones averaged, layers of classes by the nearest or most frequent."""
    out = None
    for own in sorted(set(sizes.values())):
        names = [b for b, s in sizes.items() if s == own]
        for layers, how in (([b for b in names if b not in classes], method if own > gsd else "average"), ([b for b in names if b in classes], "nearest" if own > gsd else "mode")):
            if layers:
                part = rows.filter(F.col("band").isin(layers)).select("path", "band", "r", "c0", "values")
                part = part if own == gsd else resample(part, own, gsd, how)
                out = part if out is None else out.union(part)
    if out is None:
        raise ValueError("there are no bands")
    return out


def pixels(rows: DataFrame, bands: list[str]) -> DataFrame:
    """path, r, c and a column per band: stretches of bands on one grid meet as arrays, and pixels are made of them in place."""
    c = F.col
    one = rows.filter(c("band").isin(bands)).groupBy("path", "r", "c0").agg(*[F.first(F.when(c("band") == b, c("values")), True).alias(b) for b in bands])
    one = one.select("path", "r", "c0", F.posexplode(F.arrays_zip(*bands)).alias("i", "p"))
    return one.select("path", "r", (c("c0") + c("i")).alias("c"), *[c(f"p.{b}").alias(b) for b in bands])
