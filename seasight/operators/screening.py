"""Tiles: adaptive debris thresholds, candidate counts, connected regions, verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasight.functions.spectral import FDI_THRESHOLD, INDICES, cloud_mask, water_mask
from seasight.operators.quantiles import between, percentiles
from seasight.operators.regions import labels

TILE = ["tr", "tc"]
MIN_CANDIDATES, MIN_REGION = 4, 8


def adaptive_threshold(fdi: Column, clean: Column, percentile: float = 0.999, floor: float = FDI_THRESHOLD) -> Column:
    """An aggregate of a tile, which bounds what it holds: the percentile of the index over clean water, the floor at least; the floor where there's none."""
    values = F.sort_array(F.collect_list(F.when(clean, fdi)))

    def at(v: Column) -> Column:
        k = (F.size(v) - 1) * F.lit(float(percentile))
        return between(F.get(v, F.floor(k).cast("int")), F.get(v, F.ceil(k).cast("int")), k - F.floor(k))

    return F.greatest(F.lit(floor), F.coalesce(F.get(F.transform(F.array(values), at), F.lit(0)), F.lit(floor)))


def candidates(px: DataFrame, percentile: float = 0.999, floor: float = FDI_THRESHOLD, tile: list[str] = TILE) -> DataFrame:
    """``px`` with fdi, clean, threshold (of its tile) and candidate."""
    p = px.withColumns({"fdi": INDICES["fdi"][1](), "clean": water_mask() & ~cloud_mask()})
    limits = p.groupBy(*tile).agg(adaptive_threshold(F.col("fdi"), F.col("clean"), percentile, floor).alias("threshold"))
    return p.join(limits, tile).withColumn("candidate", F.col("clean") & F.coalesce(F.col("fdi") > F.col("threshold"), F.lit(False)))


def regions(px: DataFrame, mask: str = "candidate", connectivity: int = 8, least: int = 4, tile: list[str] = TILE) -> DataFrame:
    """tile, xmin, ymin, xmax, ymax (half-open), n_pixels: connected regions of the mask in each tile.

    A tile is the unit of the screening and bounded by its size, so that one
    task labels it; regions that a tile's edge cuts stay apart
    (``regions.scene_regions`` joins them).
    """

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        d = rows.sort_values(["r", "c"]).drop_duplicates(["r", "c"])
        d["k"] = labels(d["r"].to_numpy(), d["c"].to_numpy(), connectivity)
        g = d.groupby("k").agg(ymin=("r", "min"), ymax=("r", "max"), xmin=("c", "min"), xmax=("c", "max"), n_pixels=("r", "size"))
        g = g[g["n_pixels"] >= least].reset_index(drop=True)
        return pd.DataFrame({**{k: rows[k].iloc[0] for k in tile}, "xmin": g["xmin"], "ymin": g["ymin"], "xmax": g["xmax"] + 1, "ymax": g["ymax"] + 1, "n_pixels": g["n_pixels"]}, columns=[*tile, "xmin", "ymin", "xmax", "ymax", "n_pixels"])

    schema = ", ".join([*(f"{k} long" for k in tile), "xmin long, ymin long, xmax long, ymax long, n_pixels long"])
    return px.filter(mask).select(*tile, "r", "c").groupBy(*tile).applyInPandas(label, schema)


def screen(px: DataFrame, percentile: float = 0.999, tile: list[str] = TILE) -> DataFrame:
    """tile, n_pixels, threshold, candidate_pixels, candidate_fraction, n_regions, accepted, reason: one row per tile."""
    p = candidates(px, percentile, tile=tile)
    counts = p.groupBy(*tile).agg(F.count("*").alias("n_pixels"), F.first("threshold").alias("threshold"), F.count_if("candidate").alias("candidate_pixels"))
    few = counts.filter(F.col("candidate_pixels") >= MIN_CANDIDATES).select(*tile)
    found = regions(p.join(few, tile, "left_semi"), least=MIN_REGION, tile=tile).groupBy(*tile).agg(F.count("*").alias("n_regions"))
    out = counts.join(found, tile, "left").withColumn("n_regions", F.coalesce("n_regions", F.lit(0)))
    reason = F.when(F.col("candidate_pixels") < MIN_CANDIDATES, "too few candidate pixels").when(F.col("n_regions") == 0, "no region large enough").otherwise("candidate region")
    return out.withColumns({"candidate_fraction": F.col("candidate_pixels") / F.col("n_pixels"), "accepted": F.col("n_regions") > 0, "reason": reason})


def summary(tiles: DataFrame) -> DataFrame:
    """One row: n_tiles, n_accepted, accept_rate, work_avoided, candidate_pixels; zeros for no tile. Rates have 4 digits: whole ten-thousandths of the double, half to even, as SQL's round_even."""
    n, yes = F.count("*"), F.count_if("accepted")
    share = lambda x: F.when(n > 0, F.rint(x * 1e4) / 1e4).otherwise(F.lit(0.0))
    return tiles.agg(n.alias("n_tiles"), yes.alias("n_accepted"), share(yes / n).alias("accept_rate"), share(1 - yes / n).alias("work_avoided"), F.coalesce(F.sum("candidate_pixels"), F.lit(0)).alias("candidate_pixels"))


def index_stats(px: DataFrame, names: list[str]) -> DataFrame:
    """index, mean, p50, p99, p999, water_p99: over the pixels that have data."""
    p = px.withColumns({n: INDICES[n][1]() for n in names}).withColumn("water", water_mask())
    long = p.select("water", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in names])).alias("x")).select("water", F.col("x.name").alias("index"), "x.v")
    out = long.groupBy("index").agg(F.avg("v").alias("mean"))
    for part in (percentiles(long, "v", {"p50": 0.5, "p99": 0.99, "p999": 0.999}, ("index",)), percentiles(long.filter("water"), "v", {"water_p99": 0.99}, ("index",))):
        out = out.join(part, "index", "left")  # a row per index
    return out


def detect(tiles: DataFrame, detector, schema: str) -> DataFrame:
    """The plug-in point: ``detector`` maps an iterator of pandas frames of accepted tiles to frames of ``schema``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from detector(parts)

    return tiles.filter("accepted").mapInPandas(run, schema)


def values_at(dets: DataFrame, px: DataFrame, names: list[str], width: int, height: int) -> DataFrame:
    """``dets`` with the named indices at the pixel of each box's centre, kept inside the image; NULL without data."""
    at = lambda a, b, n: F.least(F.greatest(F.rint((F.col(a) + F.col(b)) / 2), F.lit(0.0)), F.lit(n - 1.0)).cast("long")
    v = px.select("image", "r", "c", *[INDICES[n][1]().alias(n) for n in names])
    return dets.withColumns({"r": at("ymin", "ymax", height), "c": at("xmin", "xmax", width)}).join(v, ["image", "r", "c"], "left").drop("r", "c")
