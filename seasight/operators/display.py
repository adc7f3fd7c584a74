"""Bands as they are shown: contrast stretches to 0 to 255, histograms, crops, other pixel sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasight.operators.quantiles import percentiles

#: Columns that stand for red, green and blue, the first that is there.
CHANNELS = (("b04", "red", "r"), ("b03", "green", "g"), ("b02", "blue", "b"))


def _finite(c: Column) -> Column:
    v = c.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) <= float.fromhex("0x1.fffffffffffffp+1023")), v)


def channel(columns: list[str], names: tuple[str, ...]) -> str:
    """The column that one of ``names`` stands for, whatever its case."""
    by = {c.lower(): c for c in columns}
    for n in names:
        if n in by:
            return by[n]
    raise KeyError(f"none of {', '.join(names)} is a column")


def limits(px: DataFrame, bands: list[str], low: float, high: float, ignore: float | None = None, joint: bool = False) -> DataFrame:
    """lo and hi of every band in one row, as lo_BAND and hi_BAND: percentiles of its finite values, of all bands together if ``joint``."""
    if not 0 <= low < high <= 100:
        raise ValueError(f"need 0 <= low < high <= 100, got {low} and {high}")
    pair = F.explode(F.array(*[F.struct(F.lit("all" if joint else b).alias("band"), _finite(F.col(b)).alias("v")) for b in bands]))
    long = px.select(pair.alias("x")).select("x.band", "x.v").filter("v is not null")
    if ignore is not None:
        long = long.filter(F.col("v") != ignore)
    q = percentiles(long, "v", {"lo": low / 100, "hi": high / 100}, ("band",))  # a row per band
    pick = lambda b, x: F.max(F.when(F.col("band") == ("all" if joint else b), F.col(x))).alias(f"{x}_{b}")
    return q.agg(*[pick(b, x) for b in bands for x in ("lo", "hi")])


def _with_limits(px: DataFrame, lim: DataFrame) -> DataFrame:
    """``px`` with the one row of ``lim``, looked up as scalars."""
    row = lim.first()
    return px.withColumns({c: F.lit(row[c]).cast("double") for c in lim.columns})


def stretch(px: DataFrame, bands: list[str], low: float = 2.0, high: float = 98.0, per_channel: bool = True) -> DataFrame:
    """``px`` with BAND8 per band: 0 to 255 between the percentiles, cut down to whole numbers; no data is 0, a band without contrast 128, one without data 0."""
    out = _with_limits(px, limits(px, bands, low, high, joint=not per_channel))

    def to8(b: str) -> Column:
        lo, hi, v = F.col(f"lo_{b}"), F.col(f"hi_{b}"), _finite(F.col(b))
        share = F.least(F.greatest((v - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
        return F.when(lo.isNull(), 0).when(hi <= lo, 128).otherwise(F.coalesce(F.floor(share * 255), F.lit(0))).cast("int")

    return out.withColumns({f"{b}8": to8(b) for b in bands}).drop(*[f"{x}_{b}" for b in bands for x in ("lo", "hi")])


def to_rgb(px: DataFrame, how: str = "percentile", gamma: float = 1.0, low: float = 2.0, high: float = 98.0, ignore: float | None = None, most: float = 1.0) -> DataFrame:
    """``px`` with r8, g8, b8: each channel stretched by itself, to the power ``gamma``, rounded half to even.

    how: percentile, linear (least to largest) or none (0 to ``most``). No data
    counts as the low end, a channel without contrast is mid grey, and one
    without data black.
    """
    if how not in ("percentile", "linear", "none"):
        raise ValueError(f"how must be percentile, linear or none, got {how}")
    if gamma <= 0:
        raise ValueError(f"gamma must be above 0, got {gamma}")
    bands = [channel(px.columns, names) for names in CHANNELS]
    if how == "none":
        out = px.withColumns({f"{x}_{b}": F.lit(v) for b in bands for x, v in (("lo", 0.0), ("hi", float(most)))})
    else:
        out = _with_limits(px, limits(px, bands, *((low, high) if how == "percentile" else (0.0, 100.0)), ignore=ignore))

    def to8(b: str) -> Column:
        lo, hi, v = F.col(f"lo_{b}"), F.col(f"hi_{b}"), F.col(b).cast("double")
        v = F.when(v == float("inf"), hi).otherwise(F.coalesce(_finite(F.col(b)), lo))
        share = F.when(lo.isNull(), 0.0).when(hi <= lo, 0.5).otherwise(F.least(F.greatest((v - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)))
        return F.rint((share if gamma == 1 else F.pow(share, gamma)) * 255).cast("int")

    return out.withColumns({n: to8(b) for n, b in zip(("r8", "g8", "b8"), bands)}).drop(*[f"{x}_{b}" for b in bands for x in ("lo", "hi")])


def histogram(px: DataFrame, value: str, bins: int = 90, low: float = 0.5, high: float = 99.95) -> DataFrame:
    """bin, left, right, n: counts of ``bins`` equal bins between two percentiles; values outside aren't counted, and empty bins have no row."""
    v = px.select(_finite(F.col(value)).alias("v")).filter("v is not null")
    q = percentiles(v, "v", {"lo": low / 100, "hi": high / 100}).first()
    lo, hi = (q["lo"], q["hi"]) if q is not None and q["lo"] is not None else (0.0, 0.0)
    size = (hi - lo) / bins
    b = F.least(F.floor((F.col("v") - lo) / size), F.lit(bins - 1)) if size > 0 else F.lit(0).cast("long")
    out = v.filter(F.col("v").between(lo, hi)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return out.select("bin", (lo + F.col("bin") * size).alias("left"), (lo + (F.col("bin") + 1) * size).alias("right"), "n")


def crops(px: DataFrame, keys: list[str], mask: Column, width: int, height: int, pad: int = 24, minimum: int = 96) -> DataFrame:
    """keys, x0, x1, y0, y1 (half-open): a box around the masked pixels of each group, padded, grown about its middle to ``minimum``, inside the image; all of it where there are none."""
    m = px.groupBy(*keys).agg(*[f(F.when(mask, F.col(c))).alias(f"{n}_{c}") for c in ("r", "c") for n, f in (("lo", F.min), ("hi", F.max))])

    def ends(c: str, most: int) -> tuple[Column, Column]:
        a, b = F.col(f"lo_{c}") - pad, F.col(f"hi_{c}") + pad + 1
        mid = F.floor((a + b) / 2)
        small = b - a < minimum
        a, b = F.when(small, mid - minimum // 2).otherwise(a), F.when(small, mid + minimum // 2).otherwise(b)
        return F.coalesce(F.greatest(a, F.lit(0)), F.lit(0)).cast("long"), F.coalesce(F.least(b, F.lit(most)), F.lit(most)).cast("long")

    (x0, x1), (y0, y1) = ends("c", width), ends("r", height)
    return m.select(*keys, x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))


def coarsen(px: DataFrame, by: int, values: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, r, c and the values of the nearest pixel (the first of each square of ``by``): a grid of larger pixels."""
    first = (F.col("r") % by == 0) & (F.col("c") % by == 0)
    return px.filter(first).select(*keys, F.floor(F.col("r") / by).alias("r"), F.floor(F.col("c") / by).alias("c"), *values)


def refine(px: DataFrame, value: str, keys: tuple[str, ...] = (), method: str = "bilinear") -> DataFrame:
    """keys, r, c, value: a grid of half the pixel size. A pixel gives its weight to the sixteen that it reaches (bilinear), or its value to its own four (nearest); no data gives none."""
    if method not in ("bilinear", "nearest"):
        raise ValueError(f"method must be bilinear or nearest, got {method}")
    steps = ((-1, 0.25), (0, 0.75), (1, 0.75), (2, 0.25)) if method == "bilinear" else ((0, 1.0), (1, 1.0))
    near = lambda: F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in steps]))
    c = F.col
    p = px.filter(c(value).isNotNull()).select(*keys, "r", "c", value).withColumn("a", near()).withColumn("b", near())
    o = p.select(*keys, (c("r") * 2 + c("a.d")).alias("r"), (c("c") * 2 + c("b.d")).alias("c"), value, (c("a.w") * c("b.w")).alias("w"))
    return o.groupBy(*keys, "r", "c").agg((F.sum(c(value) * c("w")) / F.sum("w")).alias(value))


def window_pixels(px: DataFrame, size: int, overlap: int, width: int, height: int) -> DataFrame:
    """``px`` with row_off and col_off of every window that a pixel is in: a pixel names its windows, none is crossed with all."""
    step = size - overlap

    def own(at: Column, extent: int) -> Column:
        last = max(0, -(-(extent - size) // step)) * step if extent > size else 0
        lo = F.greatest(F.lit(0), F.ceil((at - size + 1) / step)) * step
        hi = F.least(F.floor(at / step) * step, F.lit(last))
        return F.explode(F.sequence(lo.cast("long"), hi.cast("long"), F.lit(step).cast("long")))

    return px.withColumn("row_off", own(F.col("r"), height)).withColumn("col_off", own(F.col("c"), width))
