"""Annotated patches: quality, choice, labels, training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasight.operators.catalog import CLASSES, class_name
from seasight.operators.detections import suppressed
from seasight.operators.pairs import box_pairs

# The scene class of water, those of cloud, and the limits of a usable chip.
WATER_SCL, CLOUD_SCL = 6, (8, 9, 10)
MOST_NO_DATA, MOST_CLOUD = 0.02, 0.30
# A patch of open water has at least so many debris pixels, and at most this share of others.
LEAST_DEBRIS, MOST_OTHER = 8, 0.35
DEBRIS = 1
# Codes of the annotated classes that count as open water (marine, turbid, shallow, mixed).
WATER = (7, 10, 11, 15)


def quality(px: DataFrame, keys: list[str], no_data: Column, least_water: float, most_cloud: float = MOST_CLOUD) -> DataFrame:
    """keys, n_pixels, no_data, water, cloud (shares) and reason: why a chip is no good, the first that holds; NULL if none does."""
    share = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("double"))
    scl = F.col("scl")
    q = px.groupBy(*keys).agg(F.count("*").alias("n_pixels"), share(no_data).alias("no_data"), share(scl == WATER_SCL).alias("water"), share(scl.isin(list(CLOUD_SCL))).alias("cloud"))
    reason = F.when(F.col("no_data") > MOST_NO_DATA, "no data").when(F.col("water") < least_water, "too little water").when(F.col("cloud") > most_cloud, "cloud")
    return q.withColumn("reason", reason)


def chip_windows(px: DataFrame, size: int, stride: int, wanted: Column, no_data: Column, least_water: float, least: int = 1, most_cloud: float = MOST_CLOUD, image: str = "image") -> DataFrame:
    """image, r0, c0, n_pixels, n_wanted, no_data, water, cloud (shares), reason: every window of ``size`` pixels that starts at multiples of ``stride``.

    ``px`` has (image, r, c, scl), a row per pixel. Pixels are counted in
    squares of ``stride`` first, so that only squares go to all windows over
    them; ``size`` must be a multiple of it. The reason is the first that holds
    of: outside the scene (pixels are missing), no data, too little water,
    cloud, too few wanted pixels (below ``least``); NULL if none does. A
    condition that is NULL doesn't hold. Windows without a pixel have no row.
    """
    if size % stride:
        raise ValueError(f"the size {size} must be a multiple of the stride {stride}")
    c, steps = F.col, size // stride
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    scl = c("scl")
    counts = {"n_pixels": F.count("*"), "n_wanted": n(wanted), "_none": n(no_data), "_water": n(scl == WATER_SCL), "_cloud": n(scl.isin(list(CLOUD_SCL)))}
    squares = px.filter("r is not null and c is not null").groupBy(image, F.floor(c("r") / stride).alias("_y"), F.floor(c("c") / stride).alias("_x")).agg(*[v.alias(k) for k, v in counts.items()])
    start = lambda at: F.explode(F.sequence(c(at) - (steps - 1), c(at)))
    w = squares.withColumn("r0", start("_y")).withColumn("c0", start("_x")).withColumns({"r0": c("r0") * stride, "c0": c("c0") * stride})
    w = w.groupBy(image, "r0", "c0").agg(*[F.sum(k).alias(k) for k in counts])
    share = {k: c(f"_{x}") / c("n_pixels") for k, x in (("no_data", "none"), ("water", "water"), ("cloud", "cloud"))}
    reason = F.when(c("n_pixels") < size * size, "outside the scene").when(c("no_data") > MOST_NO_DATA, "no data").when(c("water") < least_water, "too little water").when(c("cloud") > most_cloud, "cloud").when(c("n_wanted") < least, "too few wanted pixels")
    return w.withColumns(share).select(image, "r0", "c0", "n_pixels", "n_wanted", *share, reason.alias("reason"))


def choose_chips(windows: DataFrame, size: int, image: str = "image") -> DataFrame:
    """``windows`` with reason and chosen: the best first, and none that overlaps a better one that is chosen.

    Windows (image, r0, c0, n_wanted, reason) with a reason are out. Of the
    others, the one with the most wanted pixels comes first (ties: by row, then
    column); whatever overlaps it goes with the reason "overlaps a better chip",
    and so on. This is settled in rounds over the pairs that overlap, of which a
    window has at most a few times (size / stride)^2. Windows that come twice
    are one; an image of NULL is one of its own.
    """
    c = F.col
    w = windows.withColumn("_id", F.struct(image, "r0", "c0")).dropDuplicates(["_id"])
    good = w.filter("reason is null")

    def side(x: str) -> DataFrame:
        at = {f"{x}x0": c("c0"), f"{x}y0": c("r0"), f"{x}x1": c("c0") + size, f"{x}y1": c("r0") + size}
        return good.select(F.struct(image).alias(f"{x}image"), c("_id").alias(f"{x}id"), F.struct(-c("n_wanted"), "r0", "c0").alias(f"{x}rank"), *[v.cast("double").alias(k) for k, v in at.items()])

    box = lambda x: tuple(f"{x}{k}" for k in ("x0", "y0", "x1", "y1"))
    p = box_pairs(side("p_"), side("q_"), {"p_image": "q_image"}, box("p_"), box("q_"), float(size))
    p = p.filter((c("q_rank") < c("p_rank")) & (F.abs(c("p_x0") - c("q_x0")) < size) & (F.abs(c("p_y0") - c("q_y0")) < size))
    gone = suppressed(p.select(c("p_id").alias("det_id"), c("q_id").alias("by"))).select(c("det_id").alias("_id"), F.lit("overlaps a better chip").alias("_why"))
    out = w.join(gone, "_id", "left").withColumn("reason", F.coalesce("reason", "_why"))
    return out.withColumn("chosen", c("reason").isNull()).drop("_id", "_why")


def pick(px: DataFrame, key: str, limit: int, least: int = 1, most_other: float | None = None, wanted: int = DEBRIS, water: tuple[int, ...] = WATER) -> DataFrame:
    """key, n: the ``limit`` patches with the most pixels of the wanted code, ``least`` of them or more.

    With ``most_other``, patches go whose annotation is neither that code nor
    water in a larger share. Code 0 is no annotation; ties go to the first key.
    """
    code = F.col("code")
    k = px.groupBy(key).agg(F.count_if(code == wanted).alias("n"), F.count_if(code != 0).alias("annotated"), F.count_if(code.isin(list(water))).alias("wet"))
    k = k.filter(F.col("n") >= least)
    if most_other is not None:
        k = k.filter(F.col("annotated") - F.col("wet") - F.col("n") <= most_other * F.greatest("annotated", F.lit(1)))
    return k.orderBy(F.desc("n"), key).limit(limit).select(key, "n")


def labelled(px: DataFrame, least_confidence: int = 0) -> DataFrame:
    """The annotated pixels of ``px`` (code not 0), with name, the class of the code."""
    return px.filter((F.col("code") != 0) & (F.col("confidence") >= least_confidence)).withColumn("name", class_name(F.col("code")))


def split_patches(ids: DataFrame, labels: DataFrame, debris_only: bool = False) -> DataFrame:
    """roi, labels, debris: the patches of a split list with their classes by name; a patch without labels has none.

    ``labels`` has roi and bits, 0 or 1 for every class in the order of the codes.
    """
    names = F.array(*[F.lit(n) for n, _ in CLASSES])
    named = F.array_compact(F.transform("bits", lambda b, i: F.when(b == 1, F.get(names, i))))
    out = ids.join(labels.select("roi", named.alias("labels")), "roi", "left").withColumn("labels", F.coalesce("labels", F.slice(names, 1, 0)))
    out = out.withColumn("debris", F.array_contains("labels", CLASSES[DEBRIS - 1][0]))
    return out.filter("debris") if debris_only else out


def training_boxes(dets: DataFrame, classes: list[str]) -> DataFrame:
    """``dets`` with head, their label's place in ``classes`` from 0; boxes of other labels go."""
    return dets.withColumn("head", F.array_position(F.array(*[F.lit(x) for x in classes]), F.col("label")).cast("int") - 1).filter("head >= 0")
