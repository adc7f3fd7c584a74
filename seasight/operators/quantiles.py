"""Exact percentiles of whole tables, without a task that holds all values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096


def between(lo: Column, hi: Column, d: Column) -> Column:
    """The value ``d`` (0 to 1) of the way from ``lo`` to ``hi``: lo * (1 - d) + hi * d, the first product not rounded before the sum.

    So DuckDB's quantile_cont does, and a value that lies between two roundings
    goes the same way. The product's error comes from halves of 26 bits, whose
    products are exact, and the sum's from its two parts.
    """
    a, b, y = lo, 1 - d, hi * d
    head = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    x = a * b
    lost = (head(a) * head(b) - x + head(a) * (b - head(b)) + (a - head(a)) * head(b)) + (a - head(a)) * (b - head(b))
    s = x + y
    part = s - x
    exact = s + (lost + ((x - (s - part)) + (y - part)))
    # equal ends are the value; halves of huge values overflow, and infinite ones have no error
    return F.when(lo == hi, lo).when(F.greatest(F.abs(lo), F.abs(hi)) < 1e290, exact).otherwise(s)


def percentiles(df: DataFrame, value: str, fractions: dict[str, float], keys: tuple[str, ...] = (), bins: int = BINS) -> DataFrame:
    """keys, and a column per name of ``fractions``: exact percentiles, interpolated, of the finite values of each group.

    Values are counted in equal bins first; only the bins in which a wanted
    rank lies are then looked into, their equal values counted together. Groups
    must be few: a row for each, and two per fraction, go to every task. A
    group without values has no row; without ``keys`` there is always one.
    """
    c, own = F.col, ["_group", *keys]
    big = float.fromhex("0x1.fffffffffffffp+1023")
    d = df.select(F.lit(1).alias("_group"), *keys, c(value).cast("double").alias("v")).filter(c("v").isNotNull() & ~F.isnan("v") & (F.abs("v") <= big))
    span = d.groupBy(*own).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n_all"))
    place = F.when(c("hi") > c("lo"), F.least(F.floor((c("v") / 2 - c("lo") / 2) / (c("hi") / 2 - c("lo") / 2) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    binned = d.join(F.broadcast(span), own).select(*own, "v", "n_all", place.alias("bin"))
    sizes = binned.groupBy(*own, "bin").agg(F.count("*").alias("n"), F.first("n_all").alias("n_all"))
    sizes = sizes.withColumn("before", F.sum("n").over(Window.partitionBy(*own).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - c("n"))  # as many rows as bins
    name = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(f)).alias("f")) for k, f in fractions.items()]))
    asked = sizes.withColumn("q", name).withColumn("at", c("q.f") * (c("n_all") - 1)).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    asked = asked.filter((c("rank") >= c("before")) & (c("rank") < c("before") + c("n"))).select(*own, "bin", "before", c("q.name").alias("name"), "at", "rank")
    some = binned.join(F.broadcast(asked.select(*own, "bin").distinct()), [*own, "bin"], "left_semi").groupBy(*own, "bin", "v").agg(F.count("*").alias("times"))
    some = some.withColumn("upto", F.sum("times").over(Window.partitionBy(*own, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    hit = some.join(F.broadcast(asked), [*own, "bin"]).filter((c("rank") < c("before") + c("upto")) & (c("rank") >= c("before") + c("upto") - c("times")))
    of = lambda k, end: F.max(F.when((c("name") == k) & (c("rank") == end("at")), c("v")))
    one = lambda k: between(of(k, F.floor), of(k, F.ceil), F.max(F.when(c("name") == k, c("at") - F.floor("at")))).alias(k)
    return hit.groupBy(*keys).agg(*map(one, fractions))
