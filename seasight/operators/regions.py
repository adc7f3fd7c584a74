"""Connected regions of whole scenes: labelled in blocks, joined over the blocks' borders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasight.functions.spectral import cloud_mask, water_mask
from seasight.lineage import keep

#: Pixels along a block's side: what a task labels at a time.
BLOCK = 256


def labels(r: np.ndarray, c: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Of each pixel (ordered by row and column, without repeats) the first pixel's index of its region.

    Runs of a row are the nodes; they meet those of the next row that they
    touch, take the smallest neighbour and shorten chains until nothing changes.
    """
    if len(r) == 0:
        return np.zeros(0, int)
    new = np.ones(len(r), bool)
    new[1:] = (np.diff(r) != 0) | (np.diff(c) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(r)) - 1
    wide = int(c.max() - c.min()) + 5  # so that a run's neighbourhood stays within its row
    row, lo, hi = r[first] - r.min(), c[first] - c.min() + 2, c[last] - c.min() + 2
    more = 1 if connectivity == 8 else 0
    start = np.searchsorted(row * wide + hi, (row + 1) * wide + lo - more)
    stop = np.searchsorted(row * wide + lo, (row + 1) * wide + hi + more, "right")
    n = np.maximum(stop - start, 0)
    a = np.repeat(np.arange(len(first)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
    top = np.arange(len(first))
    while (top[a] != top[b]).any():
        least = np.minimum(top[a], top[b])
        np.minimum.at(top, top[a], least)
        np.minimum.at(top, top[b], least)
        while (top[top] != top).any():
            top = top[top]
    return np.repeat(first[top], last - first + 1)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node of ``edges`` (a, b), of any type that has an order.

    In a round every node hooks to its smallest neighbour, chains are shortened
    and the graph shrinks to the roots, so that each component loses half its
    nodes or more. Rounds are kept; no edge, no row.
    """
    c = F.col
    left = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    found = left.select(c("a").alias("node"), c("b").alias("root")).limit(0)
    while not left.isEmpty():
        ends = left.unionByName(left.select(c("a").alias("b"), c("b").alias("a")))
        hooks = keep(ends.groupBy(c("a").alias("node")).agg(F.min("b").alias("root")).withColumn("root", F.least("node", "root")))
        for _ in range(2):
            hooks = hooks.join(hooks.select(c("node").alias("root"), c("root").alias("next")), "root").select("node", c("next").alias("root"))
        hooks = keep(hooks)
        found = keep(found.join(hooks.select(c("node").alias("root"), c("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")).union(hooks.join(found, "node", "left_anti").select("node", "root")))
        for end in ("a", "b"):
            left = left.join(hooks.select(c("node").alias(end), "root"), end).drop(end).withColumnRenamed("root", end)
        left = keep(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    return found


def scene_regions(px: DataFrame, mask: str | Column = "candidate", connectivity: int = 8, least: int = 4, image: tuple[str, ...] = ("image",), score: str | None = None, block: int = BLOCK) -> DataFrame:
    """image columns, first_r, first_c, xmin, ymin, xmax, ymax (half-open), n_pixels, and score: the regions of the mask in whole scenes.

    The result does not depend on the ``block``: squares of so many pixels are
    labelled one by one, pixels at their borders meet those beyond, and parts
    that meet are one region, named by its first pixel by rows. ``score`` is the
    largest of that column in the region. Pixels that come twice count once, at
    their largest score; those without a place, or whose mask is NULL, not at
    all; an image of NULL is one of its own. Regions of fewer than ``least`` pixels go.
    """
    if connectivity not in (4, 8):
        raise ValueError(f"connectivity must be 4 or 8, got {connectivity}")
    c, keys = F.col, list(image)
    value = c(score).cast("double") if score else F.lit(None).cast("double")
    p = px.filter(mask).filter("r is not null and c is not null").select(*keys, c("r").cast("long").alias("r"), c("c").cast("long").alias("c"), value.alias("_score"))
    p = p.withColumns({"_by": F.floor(c("r") / block), "_bx": F.floor(c("c") / block)})

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        d = rows.sort_values(["r", "c", "_score"], ascending=[True, True, False]).drop_duplicates(["r", "c"])
        r, col = d["r"].to_numpy(), d["c"].to_numpy()
        d["k"] = labels(r, col, connectivity)
        d["first_r"], d["first_c"] = r[d["k"]], col[d["k"]]
        y, x = r % block, col % block
        rim = d[(y == 0) | (y == block - 1) | (x == 0) | (x == block - 1)].groupby("k")
        g = d.groupby("k").agg(first_r=("first_r", "first"), first_c=("first_c", "first"), xmin=("c", "min"), ymin=("r", "min"), xmax=("c", "max"), ymax=("r", "max"), n_pixels=("r", "size"), score=("_score", "max"))
        for name in ("r", "c"):
            at = rim[name].agg(list).to_dict()
            g[f"rim_{name}"] = pd.Series([at.get(k) for k in g.index], g.index, object)
        out = g.reset_index(drop=True)
        for k in keys:
            out[k] = [rows[k].iloc[0]] * len(out)
        return out[[*keys, "first_r", "first_c", "xmin", "ymin", "xmax", "ymax", "n_pixels", "score", "rim_r", "rim_c"]]

    own = ", ".join(f"`{k}` {px.schema[k].dataType.simpleString()}" for k in keys)
    parts = keep(p.groupBy(*keys, "_by", "_bx").applyInPandas(label, f"{own}, first_r long, first_c long, xmin long, ymin long, xmax long, ymax long, n_pixels long, score double, rim_r array<long>, rim_c array<long>"))
    named = parts.withColumn("node", F.struct(*keys, c("first_r").alias("r"), c("first_c").alias("c")))
    rim = named.filter("rim_r is not null").select("node", F.explode(F.arrays_zip("rim_r", "rim_c")).alias("p")).select("node", c("p.rim_r").alias("r"), c("p.rim_c").alias("c"))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    beyond = F.filter(F.array(*[F.struct((c("r") + y).alias("r"), (c("c") + x).alias("c")) for y, x in steps]), lambda q: (F.floor(q["r"] / block) != F.floor(c("r") / block)) | (F.floor(q["c"] / block) != F.floor(c("c") / block)))
    place = lambda r, col: F.struct(*[c(f"node.{k}").alias(k) for k in keys], r.alias("r"), col.alias("c")).alias("at")
    a = rim.withColumn("q", F.explode(beyond)).select(c("node").alias("a"), place(c("q.r"), c("q.c")))
    b = rim.select(c("node").alias("b"), place(c("r"), c("c")))
    whole = components(a.join(b, "at").select("a", "b"))
    region = F.coalesce("root", "node")
    out = named.drop("rim_r", "rim_c").join(whole, "node", "left").groupBy(region.alias("region")).agg(
        F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), (F.max("xmax") + 1).alias("xmax"), (F.max("ymax") + 1).alias("ymax"), F.sum("n_pixels").alias("n_pixels"), F.max("score").alias("score")
    )
    out = out.filter(c("n_pixels") >= least)
    shown = [*[c(f"region.{k}").alias(k) for k in keys], c("region.r").alias("first_r"), c("region.c").alias("first_c"), "xmin", "ymin", "xmax", "ymax", "n_pixels"]
    return out.select(*shown, *(["score"] if score else []))


def class_score(proba: str, classes: list[str], wanted: tuple[str, ...]) -> Column:
    """The summed probability of the wanted classes that the model (its ``classes``, in order) knows; 0 for none of them."""
    at = [F.get(F.col(proba), F.lit(i)) for i, x in enumerate(classes) if x in wanted]
    return sum(at[1:], at[0]) if at else F.lit(0.0)


def scored_boxes(px: DataFrame, score: str, threshold: float, label: str, least: int = 4, connectivity: int = 4, image: str = "image", block: int = BLOCK) -> DataFrame:
    """det_id, image, label, score, xmin, ymin, xmax, ymax: a box for every region of pixels that score, are water and are not cloud.

    ``px`` has (image, r, c, green, nir, scl) and the score; a pixel is in where
    its score is at least the threshold. A box's score is its region's largest.
    The water gate is needed for right results: a classifier of sea surfaces has
    no class for land. Ids are those of the region's first pixel, so that reruns agree.
    """
    hit = F.coalesce(F.col(score) >= threshold, F.lit(False)) & water_mask() & ~cloud_mask()
    found = scene_regions(px, hit, connectivity, least, (image,), score, block)
    corner = [F.col(x).cast("double").alias(x) for x in ("xmin", "ymin", "xmax", "ymax")]
    return found.select(F.xxhash64(image, "first_r", "first_c").alias("det_id"), image, F.lit(label).alias("label"), "score", *corner)
