"""From a scene's pixels to its detections: windows, screening, detector, merging, map coordinates, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasight.functions import geo
from seasight.functions.spectral import available_indices
from seasight.lineage import keep
from seasight.operators import blocks, detections, display, screening
from seasight.operators.blocks import FOUND, WINDOW, Detector
from seasight.settings import Settings


def to_detections(raw: DataFrame, width: float, height: float, labels: dict[int, str] | None = None, normalized: bool = True, order: str = "yxyx", least: float = 0.0, default: str = "marine_debris") -> DataFrame:
    """``raw`` (box, score, class) as boxes inside an image: scores below ``least`` and boxes that run backwards go, scores are cut to 0 and 1, classes without a label get the ``default``."""
    w, h = F.lit(float(width)), F.lit(float(height))
    box = geo.box_of(F.col("box"), order, w if normalized else None, h if normalized else None)
    inside = {n: F.least(F.greatest(v, F.lit(0.0)), w if n[0] == "x" else h) for n, v in box.items()}
    label = F.lit(default)
    for k, name in (labels or {}).items():
        label = F.when(F.col("class") == k, name).otherwise(label)
    out = raw.filter(F.col("score") >= least).withColumns({**inside, "label": label, "score": F.least(F.greatest(F.col("score").cast("double"), F.lit(0.0)), F.lit(1.0))})
    return out.filter(geo.valid_pixel_box()).drop("box", "class")


def georeference(dets: DataFrame, transform: tuple[float, ...], zone: int | None = None) -> DataFrame:
    """``dets`` with ring, its corners through the transform; from a UTM zone's metres (of the north) to degrees where ``zone`` names it."""
    ring = geo.box_ring(transform)
    if zone is not None:

        def degrees(p):
            lon, lat = geo.utm_inverse(p["x"], p["y"], F.lit(zone))
            return F.struct(lon.alias("x"), lat.alias("y"))

        ring = F.transform(ring, degrees)
    return dets.withColumn("ring", ring)


def detect(
    px: DataFrame,
    detector: Detector,
    width: int,
    height: int,
    settings: Settings | None = None,
    screened: bool = True,
    percentile: float = 0.999,
    transform: tuple[float, ...] | None = None,
    zone: int | None = None,
    scene_id: str | None = None,
    stretches: DataFrame | None = None,
    dtype: str = "float32",
) -> tuple[DataFrame, DataFrame]:
    """The detections of a pixel table (image, r, c, bands), and a row per window that says how it was screened.

    Every image is cut into overlapping windows. What the screening accepts, or
    every window, goes to the ``detector`` as packed blocks of all its bands
    (``blocks``), once; it maps frames of blocks to frames of FOUND, in the
    window's pixels (``blocks.per_window`` makes one of a function). Its boxes
    come back in the scene's, at or above the score threshold, those at seams
    once, with the indices at their centres and, given a transform, their ring
    on the map. ``stretches`` are those of ``px`` where a file gave them.
    """
    s = settings or Settings()
    wide = display.window_pixels(px, s.tile_size, s.tile_overlap, width, height)
    if screened:
        tiles = screening.screen(wide.withColumns({"tr": F.col("row_off"), "tc": F.col("col_off")}), percentile, tile=WINDOW)
    else:
        tiles = wide.groupBy(*WINDOW).agg(F.count("*").alias("n_pixels")).withColumns({"candidate_pixels": F.lit(0).cast("long"), "accepted": F.lit(True), "reason": F.lit("not screened")})
    tiles = keep(tiles)
    if stretches is None:
        stretches = blocks.stretches(px, [n for n, t in px.dtypes if n not in ("image", "r", "c") and t in ("double", "float", "int", "bigint", "smallint", "tinyint")])
    seen = blocks.blocks(stretches, tiles.filter("accepted"), width, height, s.tile_size, s.tile_overlap, dtype)
    raw = blocks.detect(seen, detector, FOUND)
    raw = raw.filter(F.col("score") >= s.score_threshold).withColumns({"x_off": F.col("col_off").cast("double"), "y_off": F.col("row_off").cast("double")})
    # ids by place and score, so that reruns agree
    raw = raw.withColumn("det_id", F.xxhash64("image", "row_off", "col_off", "xmin", "ymin", "xmax", "ymax", "label", "score")).dropDuplicates(["det_id"])
    found = detections.merge_tiles(raw, width, height, s.nms_iou).select("det_id", "image", *detections.BOX, "label", "score")
    found = screening.values_at(found, px, available_indices(px.columns), width, height).withColumn("scene_id", F.lit(scene_id).cast("string"))
    return (georeference(found, transform, zone) if transform else found), tiles


def detect_rows(
    rows: DataFrame, detector: Detector, bands: dict[str, str], settings: Settings | None = None, scale: float = 1.0, shift: float = 0.0, **how
) -> tuple[DataFrame, DataFrame]:
    """``detect`` over the stretches of raster files (path, band, r, c0, values), whose bands share a grid.

    ``bands`` names the columns of the pixel table by the files' bands; those
    but scl become ``values * scale + shift``. A file is an image; its number is
    that of its path's hash, so that files can be read apart.
    """
    name = F.lit(None).cast("string")
    for own, column in bands.items():
        name = F.when(F.col("band") == own, column).otherwise(name)
    s = rows.select(F.xxhash64("path").alias("image"), "r", "c0", name.alias("band"), "values").filter("band is not null")
    s = s.withColumn("values", F.when(F.col("band") == "scl", F.col("values")).otherwise(F.transform("values", lambda v: v * scale + shift)))
    s = keep(blocks.from_rows(s))
    px = blocks.pixels(s, list(bands.values()))
    size = s.agg(F.max(F.array_max("cs")) + 1, F.max("r") + 1).first()
    return detect(px, detector, int(size[0] or 1), int(size[1] or 1), settings, stretches=s, **how)


def summary(found: DataFrame, tiles: DataFrame) -> str:
    """One line: how many detections, and what the screening saved."""
    n, t = found.count(), screening.summary(tiles).first()
    return f"{n} detections | {t['n_accepted']}/{t['n_tiles']} windows screened in | {100 * t['work_avoided']:.0f}% detector calls avoided"
