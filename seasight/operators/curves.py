"""Thresholds of a score for a yes-or-no question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, bands: int = 256) -> DataFrame:
    """score, tp, n, n_pos: per row of (id, pos 0 or 1, score) how many rows and hits the threshold at its score takes, ties by id.

    No threshold takes a row without a score: it counts in n_pos alone. Counts run over bands of scores, then within each band, so that no task gets all rows.
    """
    x = rows.withColumn("band", F.floor(F.col("score") * -bands))
    sums = x.groupBy("band").agg(F.sum("pos").alias("b_tp"), F.count("*").alias("b_n"))
    before = Window.orderBy(F.asc_nulls_last("band")).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as bands
    whole = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("band", F.coalesce(F.sum("b_tp").over(before), F.lit(0)).alias("tp_0"), F.coalesce(F.sum("b_n").over(before), F.lit(0)).alias("n_0"), F.sum("b_tp").over(whole).alias("n_pos"))
    w = Window.partitionBy("band").orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return x.filter("score is not null").join(sums, "band").select("score", (F.col("tp_0") + F.sum("pos").over(w)).alias("tp"), (F.col("n_0") + F.count("*").over(w)).alias("n"), "n_pos")


def best_f1() -> Column:
    """An aggregate of ``running``."""
    return F.max(2 * F.col("tp") / (F.col("n") + F.col("n_pos")))


def recall_at(precision: float) -> Column:
    """An aggregate of ``running``: the largest recall of a threshold with at least ``precision``; NULL if none has it."""
    return F.max(F.when(F.col("tp") >= precision * F.col("n"), F.col("tp") / F.col("n_pos")))


def any_of(proba: Column, classes: list[int]) -> Column:
    """The probability that any of ``classes`` (from 0) holds."""
    return sum((F.get(proba, k).cast("double") for k in classes[1:]), F.get(proba, classes[0]).cast("double"))


def class_report(counts: DataFrame) -> DataFrame:
    """label, support, precision, recall, f1 of counts n by (truth, pred); what is never predicted has precision 0."""
    t = counts.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    p = counts.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("n_pred"))
    d = t.join(p, "label", "left").withColumn("n_pred", F.coalesce("n_pred", F.lit(0)))
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    c = F.col
    return d.select("label", "support", zero(c("tp"), c("n_pred")).alias("precision"), zero(c("tp"), c("support")).alias("recall"), zero(2 * c("tp"), c("n_pred") + c("support")).alias("f1"))


def debris_metrics(counts: DataFrame, label: str = "Marine Debris") -> DataFrame:
    """The row of ``class_report`` of the class that all is about; none where neither side has it."""
    return class_report(counts).filter(F.col("label") == label)


def overall(counts: DataFrame) -> DataFrame:
    """One row: n, accuracy, macro_f1 of counts n by (truth, pred); macro over the labels of either side."""
    c = F.col
    t = counts.groupBy(c("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(c("truth") == c("pred"), c("n")).otherwise(0)).alias("tp"))
    p = counts.groupBy(c("pred").alias("label")).agg(F.sum("n").alias("n_pred"))
    both = t.join(p, "label", "full").na.fill(0, ["support", "tp", "n_pred"])
    return both.agg(F.sum("support").alias("n"), F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg(F.when(c("n_pred") + c("support") > 0, 2 * c("tp") / (c("n_pred") + c("support"))).otherwise(0.0)).alias("macro_f1"))


def best_threshold(rows: DataFrame, bands: int = 256) -> DataFrame:
    """One row: threshold, precision, recall, f1 of the best F1 over the scores of (id, pos, score); of equal ones the highest threshold."""
    c = F.col
    scored = running(rows, bands).withColumn("f1", 2 * c("tp") / (c("n") + c("n_pos")))
    best = scored.agg(F.max_by(F.struct("score", "tp", "n", "n_pos", "f1"), F.struct("f1", "score")).alias("b"))
    return best.select(c("b.score").alias("threshold"), (c("b.tp") / c("b.n")).alias("precision"), (c("b.tp") / c("b.n_pos")).alias("recall"), c("b.f1").alias("f1"))


def permuted(df: DataFrame, feature: str, key: str, buckets: int = 64, seed: int = 7) -> DataFrame:
    """``df`` with the feature's values exchanged between rows at random, within ``buckets`` parts of the rows."""
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets))
    w = Window.partitionBy(part).orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(feature, F.coalesce(F.lag(feature).over(w), F.last(feature).over(every)))
