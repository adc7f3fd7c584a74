"""Mixing sources to target weights along a low-discrepancy schedule.

Golden-ratio points are mapped through the cumulative target shares, which
gives every slot a source; slots are ranked per source, and the k-th slot of a
source takes the k-th block of equally many words from the source's shuffled
documents, going round again where the target exceeds the source. So documents
and slots are joined by source and block, and every document says which slots
it is in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seasight.llm.common import cut, free_name, table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SLOTS = 1 << 17
SEED = "mix"
GOLDEN = 0.6180339887498949
_BINS = 1024
_SPACE = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, weight, target: shares of all words by weight, none above ``max_repeats`` times its source.

    Shares that a full source can't take go to the others by weight. In the
    order of the room per weight the full sources come first, so that running
    sums find the level at which the rest are filled. One row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((order - 1) % len(weights) + 1).cast("int"))
    t = by_source.withColumn("weight", w).withColumn("room", F.col("source_size") * max_repeats)
    by_level = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("no", F.row_number().over(by_level)).withColumn(
        "level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("room").over(before), F.lit(0))) / F.sum("weight").over(after)
    )
    fill = F.min_by("level", F.when(F.col("room") / F.col("weight") >= F.col("level"), F.col("no"))).over(everything)
    return t.withColumn("fill", fill).select(
        "source", "source_size", "weight", F.coalesce(F.least(F.col("room").cast("double"), F.col("weight") * F.col("fill")), F.col("room").cast("double")).alias("target")
    )


def schedule(targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """slot, source, k, block, start, end: which words of a source's endless stream each slot takes.

    Point n is the fraction of n times the golden ratio. A source has as many
    slots as its target needs, the last one short; where the points give it
    fewer, the missing ones follow at the end, one of each source at a time.
    About ``slots`` rows, whatever the size of the sources.
    """
    spark = targets.sparkSession
    cum = Window.orderBy(F.col("source").asc_nulls_last())
    t = targets.withColumn("goal", F.floor("target")).withColumn("total", F.sum("goal").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    t = t.withColumn("block", F.greatest(F.lit(1), F.ceil(F.col("total") / slots))).withColumn("upto", F.sum("goal").over(cum.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.filter("goal > 0").select("source", "goal", "block", ((F.col("upto") - F.col("goal")) / F.col("total")).alias("lo"), (F.col("upto") / F.col("total")).alias("hi"))
    t = t.withColumn("need", F.ceil(F.col("goal") / F.col("block")))
    bins = t.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") * _BINS), F.least(F.floor(F.col("hi") * _BINS), F.lit(_BINS - 1)))))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.expr(f"(id + 0.5D) * {GOLDEN}D - floor((id + 0.5D) * {GOLDEN}D)").alias("u"))
    points = points.withColumn("bin", F.floor(F.col("u") * _BINS))
    hit = points.join(bins, (points.bin == bins.bin) & (points.u >= bins.lo) & (points.u < bins.hi)).select("slot", "source", "goal", "block", "need")
    ranked = hit.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1)
    have = hit.groupBy(F.col("source").alias("h_source")).agg(F.count("*").alias("n"))
    late = (
        t.select("source", "goal", "block", "need")
        .join(have, F.col("source").eqNullSafe(F.col("h_source")), "left")
        .select("source", "goal", "block", "need", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        .filter("n < need")
        .select("source", "goal", "block", "need", F.explode(F.sequence("n", F.col("need") - 1)).alias("k"), "n")
        .select((slots + F.col("k") - F.col("n")).alias("slot"), "source", "goal", "block", "need", "k")
    )
    kept = ranked.filter("k < need").unionByName(late.withColumn("k", F.col("k").cast("int")))
    start = F.col("k") * F.col("block")
    return kept.select("slot", "source", F.col("k").cast("long").alias("k"), "block", start.alias("start"), F.least(start + F.col("block"), F.col("goal")).alias("end"))


def shuffled(sizes: DataFrame, seed: str = SEED) -> DataFrame:
    """``sizes`` with ``at``: the words before a document in its source's shuffled order.

    The order is that of a hash of the doc_id. Its first three digits make
    4096 parts of each source, so that no source is summed up in one task.
    """
    d = sizes.withColumn("h", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed)))).withColumn("part", F.substring("h", 1, 3))
    parts = d.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    parts = parts.withColumn("base", F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("part_size"))
    within = Window.partitionBy("source", "part").orderBy("h", "doc_id", "row_no").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("inside", F.sum("size").over(within) - F.col("size"))
    p = parts.select(F.col("source").alias("p_source"), F.col("part").alias("p_part"), "base")
    return d.join(p, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part"))).select("row_no", "doc_id", "source", "size", (F.col("base") + F.col("inside")).alias("at"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, slots: int = SLOTS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: row_no, doc_id, source, size, source_size, target, taken, n_slots, first_slot.

    size counts the words of the text (null: 0). taken counts the words the
    mix takes, repeats included: at most ``max_repeats`` times size; a source's
    sum is its target without the fraction. They are in n_slots slots of the
    schedule, the first of which is first_slot (-1: none). A null source is a
    source of its own, the last in order. Documents without words take nothing;
    reruns agree, since order and schedule depend on doc_id and sizes alone;
    rows that repeat a doc_id are documents of their own. An empty table gives
    an empty result. row_no is ``row_col``, or a number of its own.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    sizes = cut(docs.select(row.alias("row_no"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(_SPACE)), F.lit(0)).cast("long").alias("size")))
    targets = cut(source_targets(sizes, weights, max_repeats))
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    taken = _taken(shuffled(sizes, seed), cut(schedule(targets, slots)), targets)
    rows = sizes.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return rows.join(taken, "row_no", "left").select("row_no", "doc_id", "source", "size", "source_size", "target", zero("taken"), zero("n_slots"), F.coalesce("first_slot", F.lit(-1)).cast("long").alias("first_slot"))


def _taken(placed: DataFrame, slots: DataFrame, targets: DataFrame) -> DataFrame:
    """row_no, taken, n_slots, first_slot: a document's words in the blocks that slots take, joined by source and number of the block."""
    blocks = slots.groupBy("source").agg(F.max("block").alias("block"), F.max("end").alias("goal"))
    of = targets.select("source", F.col("source_size").alias("period")).join(blocks.select(F.col("source").alias("b_source"), "block", "goal"), F.col("source").eqNullSafe(F.col("b_source"))).drop("b_source")
    of = of.withColumnRenamed("source", "t_source")
    d = placed.filter("size > 0").join(of, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    # a document comes once in every turn of its source's stream, as long as the stream is needed
    d = d.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("goal") - 1) / F.col("period"))))).withColumn("lo", F.col("at") + F.col("turn") * F.col("period"))
    d = d.filter("lo < goal").withColumn("hi", F.least(F.col("lo") + F.col("size"), "goal"))
    d = d.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / F.col("block")), F.floor((F.col("hi") - 1) / F.col("block"))))).select("row_no", "source", "b", "lo", "hi")
    s = slots.select(F.col("source").alias("s_source"), "k", "slot", "start", "end")
    met = d.join(s, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("b") == F.col("k")))
    return met.groupBy("row_no").agg(F.sum(F.least("hi", "end") - F.greatest("lo", "start")).alias("taken"), F.count("*").alias("n_slots"), F.min("slot").alias("first_slot"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix takes them: every row as often as its words are taken, in whole rows.

    Slots take a source's shuffled stream in order, so that all its rows but the
    one where the stream ends are taken a whole number of times; that one is
    rounded, and a source is off its target by half a row at most. Rows without
    words, or beyond the target, go. Repeated rows each count, ids and sources
    may be null, columns may have any names, and an empty table stays empty.
    """
    row, times = free_name("row", docs), free_name("times", docs)
    # a table of its own: the numbers of its rows stay what they are
    d = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    m = mix(d, row_col=row, **how).select(F.col("row_no").alias(row), F.round(F.try_divide("taken", "size")).cast("int").alias(times)).filter(F.col(times) > 0)
    return d.join(m, row).withColumn(times, F.explode(F.sequence(F.lit(1), times))).select(docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "n_slots", "first_slot")


OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 3 AS room,
             [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s),
l AS (SELECT *, row_number() OVER o AS no,
             CAST((SELECT sum(source_size) FROM s) - coalesce(sum(room) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
      FROM w WINDOW o AS (ORDER BY CAST(room AS DOUBLE) / weight, source NULLS LAST)),
f AS (SELECT arg_min(level, no) AS fill FROM l WHERE CAST(room AS DOUBLE) / weight >= level),
t AS (SELECT source, source_size, coalesce(least(CAST(room AS DOUBLE), weight * fill), CAST(room AS DOUBLE)) AS target FROM l, f),
p AS (SELECT d.*, CAST(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS at FROM d),
g AS (SELECT source, source_size, CAST(floor(target) AS BIGINT) AS goal, CAST(sum(floor(target)) OVER () AS BIGINT) AS total,
             CAST(sum(floor(target)) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM t),
c AS (SELECT source, source_size, goal, greatest(1, CAST(ceil(total / {SLOTS}e0) AS BIGINT)) AS block,
             (upto - goal) / CAST(total AS DOUBLE) AS lo, upto / CAST(total AS DOUBLE) AS hi FROM g WHERE goal > 0),
u AS (SELECT i AS slot, (i + 0.5e0) * {GOLDEN}e0 - floor((i + 0.5e0) * {GOLDEN}e0) AS u FROM range({SLOTS}) r(i)),
k AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k FROM u JOIN c ON u >= lo AND u < hi),
n AS (SELECT c.source, block, goal, CAST(ceil(goal / CAST(block AS DOUBLE)) AS BIGINT) AS need, (SELECT count(*) FROM k WHERE k.source IS NOT DISTINCT FROM c.source) AS n FROM c),
a AS (SELECT slot, k.source, k FROM k JOIN n ON k.source IS NOT DISTINCT FROM n.source WHERE k < need
      UNION ALL SELECT {SLOTS} + x - n, source, x FROM (SELECT source, n, unnest(range(n, need)) AS x FROM n WHERE n < need)),
x AS (SELECT p.doc_id, p.h, p.source, p.size, c.block, c.goal, p.at + turn * c.source_size AS lo
      FROM (SELECT *, unnest(range(0, (goal - 1) // source_size + 1)) AS turn FROM c) c JOIN p ON p.source IS NOT DISTINCT FROM c.source
      WHERE p.size > 0 AND p.at + turn * c.source_size < c.goal),
y AS (SELECT *, least(lo + size, goal) AS hi, unnest(range(lo // block, (least(lo + size, goal) - 1) // block + 1)) AS b FROM x),
z AS (SELECT doc_id, y.source, CAST(sum(least(hi, (k + 1) * block, goal) - greatest(lo, k * block)) AS BIGINT) AS taken, count(*) AS n_slots, min(slot) AS first_slot
      FROM y JOIN a ON y.source IS NOT DISTINCT FROM a.source AND y.b = a.k GROUP BY doc_id, y.source)
SELECT p.doc_id, p.size, t.source_size, t.target, coalesce(taken, 0) AS taken, coalesce(n_slots, 0) AS n_slots, coalesce(first_slot, -1) AS first_slot
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN z ON p.doc_id = z.doc_id AND p.source IS NOT DISTINCT FROM z.source
"""
