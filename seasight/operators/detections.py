"""Detections: clipping, suppression, matching with ground truth, precision and recall."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasight.functions.geo import iou
from seasight.lineage import keep
from seasight.operators.pairs import box_pairs

BOX = ["xmin", "ymin", "xmax", "ymax"]
TARGETS = ("sargassum", "marine_debris")
CELL = 16.0


def offset(dets: DataFrame, dx, dy) -> DataFrame:
    return dets.withColumns({"xmin": F.col("xmin") + dx, "xmax": F.col("xmax") + dx, "ymin": F.col("ymin") + dy, "ymax": F.col("ymax") + dy})


def clip(dets: DataFrame, width: float, height: float, min_area: float = 1.0) -> DataFrame:
    """Boxes cut to the frame; those without width, height or ``min_area`` go."""
    inside = lambda c, most: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(most)))
    d = dets.withColumns({"xmin": inside("xmin", width), "xmax": inside("xmax", width), "ymin": inside("ymin", height), "ymax": inside("ymax", height)})
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    return d.filter((w > 0) & (h > 0) & (w * h >= min_area))


def iou_pairs(dets: DataFrame, gts: DataFrame, threshold: float = 0.5, by_label: bool = True, cell: float = CELL, better: bool = False) -> DataFrame:
    """det_id, gt_id, image, label, score, iou of every pair at or above ``threshold`` (over 0).

    Boxes meet in cells of the larger one's size, from ``cell`` up (``box_pairs``).
    With ``better``, gts has scores, and a box meets only those of a higher one;
    of equal scores the smaller id is better.
    """
    g = gts.select(*[F.col(c).alias(f"g_{c}") for c in ["image", "label", *BOX]], "gt_id", *([F.col("score").alias("g_score")] if better else []))
    on = {"image": "g_image"} | ({"label": "g_label"} if by_label else {})
    met = box_pairs(dets, g, on, tuple(BOX), tuple(f"g_{c}" for c in BOX), cell)
    if better:
        met = met.filter((F.col("g_score") > F.col("score")) | ((F.col("g_score") == F.col("score")) & (F.col("gt_id") < F.col("det_id"))))
    return met.withColumn("iou", iou()).filter(F.col("iou") >= threshold).select("det_id", "gt_id", "image", "label", "g_label", "score", "iou")


def match(dets: DataFrame, gts: DataFrame, threshold: float = 0.5, by_label: bool = True) -> DataFrame:
    """det_id, gt_id, iou: greedily, by falling score, each detection takes its best free ground truth.

    Ties go to the smaller det_id, then gt_id.
    """
    return greedy(iou_pairs(dets, gts, threshold, by_label))


def greedy(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, det_id, gt_id, iou of the greedy match, for each value of the ``keys``.

    A pair whose ground truth is the detection's best, and whose detection has
    the highest score of all that overlap the ground truth, is in the match.
    Such pairs are taken in rounds, each without what the last one took.
    """
    p = keep(pairs.select(*keys, "det_id", "gt_id", "iou", "score"))
    out = []
    while not p.isEmpty():
        first = p.groupBy(*keys, "det_id").agg(F.max_by("gt_id", F.struct("iou", -F.col("gt_id"))).alias("gt_id"))
        best = p.groupBy(*keys, "gt_id").agg(F.max_by("det_id", F.struct("score", -F.col("det_id"))).alias("det_id"))
        won = keep(p.join(first, [*keys, "det_id", "gt_id"]).join(best, [*keys, "det_id", "gt_id"]).select(*keys, "det_id", "gt_id", "iou"))
        out.append(won)
        p = keep(p.join(won, [*keys, "det_id"], "left_anti").join(won, [*keys, "gt_id"], "left_anti"))
    return reduce(DataFrame.union, out) if out else p.drop("score")


def hit_flags(dets: DataFrame, matches: DataFrame) -> DataFrame:
    """``dets`` with hit: whether the match has the detection."""
    return dets.join(matches.select("det_id", F.lit(True).alias("hit")), "det_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


#: IoU thresholds of the sweep.
THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


def sweep(dets: DataFrame, gts: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """threshold, label, ap: average precision at every IoU threshold.

    Boxes are joined to pairs once, kept before they are repeated by threshold
    (in one step with the join, that took most of its time), and a detection carries an array of hits,
    one per threshold, through one pass of running counts (as in ``pr_curve``).
    """
    level = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    pairs = keep(iou_pairs(dets, gts, min(thresholds)))
    matches = greedy(pairs.withColumn("threshold", level).filter("iou >= threshold"), ("threshold",))
    hits = matches.groupBy("det_id").agg(F.collect_set("threshold").alias("at"))
    c, each = F.col, range(len(thresholds))
    d = dets.select("label", "det_id", "score").join(hits, "det_id", "left").withColumn("band", F.coalesce(F.floor(c("score") * -BANDS), F.lit(1)))
    d = d.select("label", "det_id", "score", "band", *[F.coalesce(F.array_contains("at", t), F.lit(False)).cast("long").alias(f"h{i}") for i, t in enumerate(thresholds)])
    before = Window.partitionBy("label").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as bands
    sums = d.groupBy("label", "band").agg(F.count("*").alias("n"), *[F.sum(f"h{i}").alias(f"s{i}") for i in each])
    sums = sums.select("label", "band", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(x) for x in ("n", *(f"s{i}" for i in each))])
    truths = gts.groupBy("label").agg(F.count("*").alias("n_gt"))  # a row per label
    w = Window.partitionBy("label", "band").orderBy(F.desc("score"), "det_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(sums, ["label", "band"]).join(truths, "label").withColumn("rank", F.row_number().over(w) + c("n"))
    d = d.withColumns({f"p{i}": (F.sum(f"h{i}").over(upto) + c(f"s{i}")) / c("rank") for i in each})
    after = Window.partitionBy("label").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    later = d.groupBy("label", "band").agg(*[F.max(f"p{i}").alias(f"m{i}") for i in each]).select("label", "band", *[F.max(f"m{i}").over(after).alias(f"m{i}") for i in each])
    on = Window.partitionBy("label", "band").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)  # grows row by row; one that shrinks is computed anew for each
    d = d.withColumns({f"o{i}": F.max(f"p{i}").over(on) for i in each}).join(later, ["label", "band"])
    ap = d.groupBy("label").agg(*[(F.sum(c(f"h{i}") * F.greatest(f"o{i}", f"m{i}")) / F.max("n_gt")).alias(f"ap{i}") for i in each])
    one = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), c(f"ap{i}").alias("ap")) for i, t in enumerate(thresholds)]))
    return ap.select("label", one.alias("x")).select("x.threshold", "label", "x.ap")


def merge_tiles(dets: DataFrame, width: float, height: float, threshold: float = 0.5, keys: tuple[str, ...] = ("image", "label")) -> DataFrame:
    """Boxes of tiles (with the tile's corner x_off, y_off) as the scene's: moved, cut to it, those at seams suppressed once."""
    return nms(clip(offset(dets, F.col("x_off"), F.col("y_off")), width, height), threshold, keys)


def nms(dets: DataFrame, threshold: float = 0.5, keys: tuple[str, ...] = ("image", "label")) -> DataFrame:
    """``dets`` without boxes that a kept box of higher score overlaps by more than ``threshold``; ties go to the smaller det_id."""
    a = dets.select("det_id", "score", "image", "label", *BOX)
    worse = iou_pairs(a, a.withColumnsRenamed({"det_id": "gt_id"}), 1e-9, "label" in keys, better=True).filter(F.col("iou") > threshold)
    return dets.join(suppressed(worse.select("det_id", F.col("gt_id").alias("by"))), "det_id", "left_anti")


def suppressed(pairs: DataFrame) -> DataFrame:
    """det_id of the boxes that go, of ``pairs`` (det_id, by) of a box with a better one that it overlaps.

    A box that no better one is left to suppress is kept, and those that it
    overlaps go. That is settled in rounds, each over the pairs of which neither
    box is decided yet; as many rounds as the longest chain of overlaps takes.
    """
    pairs = keep(pairs)
    gone = [pairs.select("det_id").limit(0)]
    while not pairs.isEmpty():
        kept = pairs.select("by").distinct().join(pairs.select(F.col("det_id").alias("by")), "by", "left_anti")
        lost = keep(pairs.join(kept, "by", "left_semi").select("det_id").distinct())
        gone.append(lost)
        pairs = keep(pairs.join(lost, "det_id", "left_anti").join(lost.select(F.col("det_id").alias("by")), "by", "left_anti"))
    return reduce(DataFrame.union, gone)


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall, F1; nothing predicted is precise, nothing there is recalled, and F1 is 0 where both are."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(1.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(1.0))
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def class_counts(dets: DataFrame, gts: DataFrame, matches: DataFrame) -> DataFrame:
    """label, tp, fp, fn, of every label that either side has."""
    d = dets.join(matches.select("det_id").withColumn("hit", F.lit(1)), "det_id", "left").groupBy("label").agg(F.count("hit").alias("tp"), F.count("*").alias("n_det"))
    g = gts.groupBy("label").agg(F.count("*").alias("n_gt"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return d.join(g, "label", "full").select("label", z("tp").alias("tp"), (z("n_det") - z("tp")).alias("fp"), (z("n_gt") - z("tp")).alias("fn"))


#: Bands of scores in which running counts are made.
BANDS = 4096


def pr_curve(dets: DataFrame, gts: DataFrame, matches: DataFrame, keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """keys, det_id, rank, tp, recall, precision, envelope, hit, n_gt: one row per detection, by falling score, per ``keys``.

    Counts run over bands of scores first and then within each band, so that a
    label with most of the rows isn't one task. A key without ground truth has
    no curve.
    """
    keys = list(keys)
    own = [k for k in keys if k in matches.columns]
    d = dets.join(matches.select("det_id", *own).withColumn("hit", F.lit(1)), ["det_id", *own], "left").withColumn("hit", F.coalesce("hit", F.lit(0))).withColumn("band", F.coalesce(F.floor(F.col("score") * -BANDS), F.lit(1)))
    d = d.select(*keys, "det_id", "score", "hit", "band")
    before = Window.partitionBy(*keys).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as bands
    sums = d.groupBy(*keys, "band").agg(F.sum("hit").alias("b_tp"), F.count("*").alias("b_n"))
    sums = sums.select(*keys, "band", *[F.coalesce(F.sum(f"b_{c}").over(before), F.lit(0)).alias(f"{c}_0") for c in ("tp", "n")])
    truths = gts.groupBy("label").agg(F.count("*").alias("n_gt"))  # a row per label
    w = Window.partitionBy(*keys, "band").orderBy(F.desc("score"), "det_id")
    d = d.join(sums, [*keys, "band"]).join(F.broadcast(truths), "label")
    d = d.withColumn("rank", (F.row_number().over(w) + F.col("n_0")).cast("long")).withColumn("tp", F.sum("hit").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("tp_0"))
    d = d.withColumns({"recall": F.col("tp") / F.col("n_gt"), "precision": F.col("tp") / F.col("rank")})
    after = Window.partitionBy(*keys).orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    later = d.groupBy(*keys, "band").agg(F.max("precision").alias("b_most")).select(*keys, "band", F.max("b_most").over(after).alias("later"))
    up = Window.partitionBy(*keys, "band").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)  # grows row by row; one that shrinks is computed anew for each
    d = d.withColumn("own", F.max("precision").over(up)).join(later, [*keys, "band"])
    return d.select(*keys, "det_id", "rank", "tp", "recall", "precision", F.greatest("own", "later").alias("envelope"), "hit", "n_gt")


def average_precision(curve: DataFrame, method: str = "all", keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """keys, ap: all points (each hit is a step of recall), or the mean of the envelope at 101 recall levels."""
    if method == "all":
        return curve.groupBy(*keys).agg((F.sum(F.col("hit") * F.col("envelope")) / F.max("n_gt")).alias("ap"))
    levels = curve.withColumn("k", F.explode(F.expr("sequence(0, 100)"))).filter(F.col("recall") >= F.col("k") * F.lit(0.01))
    best = levels.groupBy(*keys, "k").agg(F.max("envelope").alias("p"))
    return best.groupBy(*keys).agg((F.sum("p") / 101).alias("ap"))


def evaluate(dets: DataFrame, gts: DataFrame, threshold: float = 0.5, min_score: float = 0.0) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1, ap: a row per label, and one of label ``all`` (micro counts, mean ap)."""
    d = dets.filter(F.col("score") >= min_score)
    m = match(d, gts, threshold)
    per = class_counts(d, gts, m).join(average_precision(pr_curve(d, gts, m)), "label", "left")
    both = per.unionByName(per.agg(F.lit("all").alias("label"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], F.avg("ap").alias("ap")))
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return both.select("label", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "ap")


def confusion(dets: DataFrame, gts: DataFrame, matches: DataFrame, background: str = "background") -> DataFrame:
    """truth, predicted, n: matches without regard to label; what has no match goes with the background."""
    d = dets.select("det_id", F.col("label").alias("predicted")).join(matches.select("det_id", "gt_id"), "det_id", "left")
    g = gts.select("gt_id", F.col("label").alias("truth"))
    both = d.join(g, "gt_id", "full")
    return both.groupBy(F.coalesce("truth", F.lit(background)).alias("truth"), F.coalesce("predicted", F.lit(background)).alias("predicted")).agg(F.count("*").alias("n"))


# Surface classes in order, and those commonly taken for debris.
SURFACES = ("marine_debris", "sargassum", "ship", "ship_wake", "sea_foam", "cloud", "sediment_plume", "open_water", "unknown")
CONFUSERS = ("sargassum", "ship_wake", "sea_foam", "sediment_plume")


def is_target(label: Column) -> Column:
    return label == "marine_debris"


def is_confuser(label: Column) -> Column:
    return label.isin(list(CONFUSERS))


def present_labels(dets: DataFrame, gts: DataFrame) -> DataFrame:
    """label, place: the labels of either side, with their place in the order of surface classes, from 1."""
    both = dets.select("label").union(gts.select("label")).distinct()
    return both.select("label", F.array_position(F.array(*[F.lit(s) for s in SURFACES]), F.col("label")).cast("int").alias("place"))
