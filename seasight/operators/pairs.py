"""Pairs of boxes that meet, of any sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(box: tuple[str, ...], cell: float) -> Column:
    """The level whose cells, ``cell`` * 2^level a side, a box is no longer than: it lies in four of them at most."""
    x0, y0, x1, y1 = map(F.col, box)
    size = F.greatest(x1 - x0, y1 - y0)
    return F.when(size > cell, F.ceil(F.log2(size / cell))).otherwise(F.lit(0)).cast("int")


def _celled(df: DataFrame, box: tuple[str, ...], cell: float, others: list[int], at: str) -> DataFrame:
    """Rows by the cells of their own level and of the coarser ones among ``others``."""
    x0, y0, x1, y1 = map(F.col, box)
    coarser = F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > F.col(f"{at}own"))
    d = df.withColumn(f"{at}own", _level(box, cell)).withColumn(f"{at}level", F.explode(F.concat(F.array(f"{at}own"), coarser)))
    side = cell * F.pow(F.lit(2.0), F.col(f"{at}level"))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / side), F.floor(hi / side)))
    return d.withColumn(f"{at}cx", span(x0, x1)).withColumn(f"{at}cy", span(y0, y1))


def box_pairs(a: DataFrame, b: DataFrame, on: dict[str, str], box_a: tuple[str, ...], box_b: tuple[str, ...], cell: float) -> DataFrame:
    """Rows of ``a`` beside those of ``b`` whose boxes overlap or touch, equal in the columns ``on``; no name is in both.

    Boxes meet in cells of the larger one's level, so that one of any size has
    a few rows for every level that there is, not one for every small cell. A
    pair comes once, from the cell of its overlap's least corner.
    """
    levels = [[r[0] for r in d.select(_level(box, cell)).distinct().collect()] for d, box in ((a, box_a), (b, box_b))]  # as many as sizes, by powers of two
    p, q = _celled(a, box_a, cell, levels[1], "_a_"), _celled(b, box_b, cell, levels[0], "_b_")
    c = F.col
    same = (c("_a_level") == c("_b_level")) & (c("_a_cx") == c("_b_cx")) & (c("_a_cy") == c("_b_cy"))
    for x, y in on.items():
        same = same & (c(x) == c(y))
    side = cell * F.pow(F.lit(2.0), c("_a_level"))
    low = [F.greatest(c(box_a[i]), c(box_b[i])) for i in (0, 1)]
    meet = (low[0] <= F.least(c(box_a[2]), c(box_b[2]))) & (low[1] <= F.least(c(box_a[3]), c(box_b[3])))
    once = (c("_a_level") == F.greatest("_a_own", "_b_own")) & (c("_a_cx") == F.floor(low[0] / side)) & (c("_a_cy") == F.floor(low[1] / side))
    return p.join(q, same & meet & once).select(*a.columns, *b.columns)
