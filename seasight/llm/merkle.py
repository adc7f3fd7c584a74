"""Merkle manifest of a dataset, with leaf coordinates from bitmap ranks.

The ids of a group are bits of a bitmap, in chunks of 4,096: a mask of the
words that aren't zero, those words, and the number of bits before each. A
directory over chunks, by powers of 4,096, gives the bits before a chunk. A
row's place is then a look-up and a count of bits, and no leaves are sorted.
Blocks of 256 places are arrays of slots in which eight levels are reduced at a
time; a block's node has a slot in a block of the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seasight.llm.common import cut, table

#: Levels that a block reduces, bits of a level of the directory, and every how many rows by crc32 of the id are tampered with.
LEVELS, SPAN, TAMPERED = 8, 12, 7


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(_field, (doc_id, source, lang, n_chars, text))), 256)


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _below(i: Column) -> Column:
    """The bits below bit i."""
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), i.cast("int")))


def _low(c: Column, bits: int) -> Column:
    return c.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def numbered(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with ``at``: the place of a row in the order of ``keys``, from 0; sorted over all tasks, so that no task holds more than its part."""
    d = cut(df.orderBy(*keys).withColumn("at", F.monotonically_increasing_id()))
    before, starts = 0, []
    for r in sorted(d.groupBy(F.shiftright("at", 33).alias("part")).count().collect(), key=lambda r: r["part"]):
        starts.append((r["part"], before))
        before += r["count"]
    parts = F.broadcast(d.sparkSession.createDataFrame(starts, "part long, start long"))  # a row per task
    return d.withColumn("part", F.shiftright("at", 33)).join(parts, "part").withColumn("at", F.col("start") + _low(F.col("at"), 33)).drop("part", "start")


def _before(counts: DataFrame) -> DataFrame:
    """g, c, n and base: of a group the sum of n over smaller c. Windows hold 4,096 rows of a group at most."""
    lo, hi = counts.agg(F.min("c"), F.max("c")).first()
    if lo is None or hi - lo < 1 << SPAN:
        return counts.withColumn("base", F.sum("n").over(Window.partitionBy("g").orderBy("c")) - F.col("n"))
    counts = counts.withColumn("up", F.shiftright("c", SPAN))
    ups = _before(cut(counts.groupBy("g", F.col("up").alias("c")).agg(F.sum("n").alias("n")))).select("g", F.col("c").alias("up"), F.col("base").alias("start"))
    inner = F.sum("n").over(Window.partitionBy("g", "up").orderBy("c")) - F.col("n")
    return counts.withColumn("inner", inner).join(ups, ["g", "up"]).select("g", "c", "n", (F.col("start") + F.col("inner")).alias("base"))


def bitmaps(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """g, c, mask, words, before, extra, base: the bitmap of a group (g) of ids (doc_id), by chunks, with its directory.

    ``repeated`` (g, doc_id, n) has the ids of several rows; ``extra`` of a chunk says how many more rows each has.
    """
    words = rows.groupBy("g", F.shiftright("doc_id", 6).alias("w")).agg(F.bit_or(_bit(_low(F.col("doc_id"), 6))).alias("bits"))
    chunks = words.groupBy("g", F.shiftright("w", 6).alias("c")).agg(
        F.bit_or(_bit(_low(F.col("w"), 6))).alias("mask"),
        F.transform(F.array_sort(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("words"),
        F.sum(F.bit_count("bits")).alias("n"),
    )
    upto = F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.aggregate(F.slice("words", 1, i), F.lit(0), lambda a, x: a + F.bit_count(x)))
    more = repeated.groupBy("g", F.shiftright("doc_id", 12).alias("c")).agg(F.collect_list(F.struct(_low(F.col("doc_id"), 12).alias("at"), (F.col("n") - 1).alias("n"))).alias("extra"), F.sum(F.col("n") - 1).alias("also"))
    chunks = chunks.join(more, ["g", "c"], "left").withColumn("n", F.col("n") + F.coalesce("also", F.lit(0)))
    chunks = cut(chunks.select("g", "c", "mask", "words", upto.alias("before"), "extra", "n"))
    return chunks.drop("n").join(_before(chunks.select("g", "c", "n")).select("g", "c", "base"), ["g", "c"])


def rank_of(doc_id: Column) -> Column:
    """The rows before a doc_id, of a row joined with its chunk."""
    word, bit = _low(F.shiftright(doc_id, 6), 6), _low(doc_id, 6)
    at = F.bit_count(F.col("mask").bitwiseAND(_below(word)))
    extra = F.aggregate(F.coalesce("extra", F.array().cast("array<struct<at:bigint,n:bigint>>")), F.lit(0).cast("long"), lambda a, x: a + F.when(x["at"] < _low(doc_id, 12), x["n"]).otherwise(0))
    return F.col("base") + F.get("before", at) + F.bit_count(F.get("words", at).bitwiseAND(_below(bit))) + extra


def ranked(leaves: DataFrame) -> DataFrame:
    """``leaves`` (g, doc_id and leaf, and others) with ``rank``, the row's place in its group by doc_id, nulls first, and ``total``, the group's rows.

    Rows of one id, and those without one, go by their leaves; only these are sorted.
    """
    groups = cut(leaves.groupBy("g").agg(F.count("*").alias("total"), F.count_if(F.col("doc_id").isNull()).alias("nulls")))
    some = leaves.filter("doc_id is not null")
    repeated = cut(some.groupBy("g", "doc_id").agg(F.count("*").alias("n")).filter("n > 1"))
    chunks = bitmaps(some, repeated).join(groups, "g")
    again = F.exists(F.coalesce("extra", F.array().cast("array<struct<at:bigint,n:bigint>>")), lambda x: x["at"] == _low(F.col("doc_id"), 12))
    place = [(F.col("nulls") + rank_of(F.col("doc_id"))).alias("rank"), "total"]
    met = cut(some.withColumn("c", F.shiftright("doc_id", 12)).join(chunks, ["g", "c"]).select(*leaves.columns, *place, again.alias("again")))
    if repeated.isEmpty() and not groups.agg(F.sum("nulls")).first()[0]:
        return met.drop("again")
    none = leaves.filter("doc_id is null").join(groups, "g").select(*leaves.columns, F.lit(0).cast("long").alias("rank"), "total")
    odd = cut(numbered(met.filter("again").drop("again").union(none), "g", "doc_id", "leaf"))
    first = odd.groupBy(F.col("g").alias("g_"), F.col("doc_id").alias("d_")).agg(F.min("at").alias("first"))
    odd = odd.join(first, (F.col("g") == F.col("g_")) & F.col("doc_id").eqNullSafe(F.col("d_"))).withColumn("rank", F.col("rank") + F.col("at") - F.col("first"))
    return met.filter("not again").drop("again").union(odd.select(*leaves.columns, "rank", "total"))


def _pairs(a: Column) -> Column:
    """The next level: every two consecutive nodes become one, and a last one alone too."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 2).cast("int")), lambda i: F.sha2(F.concat(F.get(a, i * 2), F.coalesce(F.get(a, i * 2 + 1), F.lit(""))), 256))


def reduced(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of blocks: g, block, height, levels and items, of ``nodes`` (g, rank, total, node, item).

    ``levels`` are a block's arrays of nodes from its slots up, ``height`` the
    levels under it. The last round has a block per group.
    """
    rounds, height = [], 0
    most = nodes.agg(F.max("total")).first()[0] or 0
    while True:
        slots = F.array_sort(F.collect_list(F.struct("rank", "node", "item")))
        b = nodes.groupBy("g", F.shiftright("rank", LEVELS).alias("block")).agg(slots.alias("slots"), F.first("total").alias("total"))
        # the bits of the last rank are the levels above the leaves
        all_ = F.when(F.col("total") > 1, F.length(F.bin(F.col("total") - 1))).otherwise(0)
        b = b.withColumn("left", F.least(F.lit(LEVELS), F.greatest(F.lit(0), all_ - height)))
        own = F.array(F.transform("slots", lambda x: x["node"]))
        levels = F.when(F.col("left") == 0, own).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest("left", F.lit(1))), own, lambda a, _: F.array_append(a, _pairs(F.element_at(a, -1)))))
        b = cut(b.select("g", "block", "total", "left", F.transform("slots", lambda x: x["item"]).alias("items"), levels.alias("levels")))
        rounds.append(b)
        height += LEVELS
        if most <= 1 << height:
            return rounds
        node = F.get(F.element_at("levels", -1), F.lit(0))
        nodes = b.select("g", F.col("block").alias("rank"), "total", node.alias("node"), F.lit(None).cast("string").alias("item"))


def proofs(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """g, path, item and the columns of ``above`` (g, path and others), for every node that the first round began with.

    A path has an entry per level, from the leaf up: the side of the sibling
    (L or R) and its digest, or nothing where there is none.
    """
    more = [c for c in above.columns if c not in ("g", "path")]
    up = above.withColumn("block", F.lit(0).cast("long"))
    for b in reversed(rounds):
        b = b.join(up.withColumnRenamed("path", "upper"), ["g", "block"]).withColumn("slot", F.explode(F.sequence(F.lit(0), F.size("items") - 1)))
        at = lambda i: F.call_function("shiftright", F.col("slot"), i)
        side = lambda i: F.when(at(i).bitwiseAND(F.lit(1)) == 1, "L").otherwise("R")
        sibling = lambda i: F.get(F.get("levels", i), at(i).bitwiseXOR(F.lit(1)))
        path = F.transform(F.slice(F.sequence(F.lit(0), F.lit(LEVELS)), F.lit(1), F.col("left")), lambda i: F.coalesce(F.concat(side(i), sibling(i)), F.lit("")))
        up = b.select("g", ((F.col("block") * (1 << LEVELS)) + F.col("slot")).alias("block"), F.concat(path, "upper").alias("path"), F.get("items", "slot").alias("item"), *more)
        last, up = up, up.drop("item")
    return last.drop("block")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    sibling = lambda x, side: F.when(F.startswith(x, F.lit(side)), F.substring(x, 2, 64)).otherwise(F.lit(""))
    return F.aggregate(path, leaf, lambda a, x: F.sha2(F.concat(sibling(x, "L"), a, sibling(x, "R")), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is a digest of doc_id, source, lang, n_chars and text, in which null
    differs from any value. Leaves of a language, null one of them, are a tree
    in the order of doc_id, nulls first; rows of one id go by their leaves. The
    trees' roots, by language, null first, are a tree as well. Where
    ``tampered`` holds, the row is held against its path with n_chars one
    larger; nulls stay. An empty table gives no rows; other columns are not
    looked at.
    """
    source, lang, n_chars, text = F.col("source"), F.col("lang"), F.col("n_chars"), F.col(text_col)
    id_ = F.col(id_col).cast("long")
    hit = F.lit(False) if tampered is None else tampered
    bad = F.when(hit, leaf_of(id_, source, lang, n_chars.cast("decimal(20,0)") + 1, text))
    g = F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))  # null first, and ordered as the languages are
    leaves = cut(docs.select(g.alias("g"), id_.alias("doc_id"), leaf_of(id_, source, lang, n_chars, text).alias("leaf"), bad.alias("bad")))
    nodes = ranked(leaves).select("g", "rank", "total", F.col("leaf").alias("node"), F.struct("doc_id", "leaf", "bad").alias("item"))
    rounds = reduced(nodes)
    subroots = rounds[-1].select("g", F.get(F.element_at("levels", -1), F.lit(0)).alias("subroot"))
    subroots = cut(numbered(subroots, "g"))
    n = subroots.count()
    top = reduced(subroots.select(F.lit("").alias("g"), F.col("at").alias("rank"), F.lit(n).cast("long").alias("total"), F.col("subroot").alias("node"), F.struct(F.col("g").alias("group"), "subroot").alias("item")))
    root = top[-1].select("g", F.get(F.element_at("levels", -1), F.lit(0)).alias("root"), F.array().cast("array<string>").alias("path"))
    above = proofs(top, root).select(F.col("item.group").alias("g"), "item.subroot", "root", "path")
    out = proofs(rounds, cut(above)).select("item.doc_id", "item.leaf", "subroot", "root", "path", F.coalesce("item.bad", "item.leaf").alias("seen"))
    siblings = F.array_join(F.transform("path", lambda x: F.substring(x, 2, 64)), "")
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.col("seen"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0)


_F = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_F.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
OP13_SQL = f"""
WITH RECURSIVE e(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM e WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM e WHERE k = 8),
h AS (SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf, {_LEAF.format(n="(n_chars + 1)")} AS bad,
  xor(4294967295, list_reduce(list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT),
      lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295)) AS crc FROM documents, crc),
d AS MATERIALIZED (SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, doc_id, lang, leaf,
  CASE WHEN crc % {TAMPERED} = 0 THEN bad ELSE leaf END AS seen FROM h),
t(lang, lvl, idx, node, n) AS (
  SELECT lang, 0, rank, leaf, count(*) OVER (PARTITION BY lang) FROM d
  UNION ALL
  SELECT lang, lvl + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, lvl, idx // 2),
s AS MATERIALIZED (SELECT lang, lvl AS height, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, idx, node, n) AS (
  SELECT 0, pos, subroot, n FROM s
  UNION ALL SELECT lvl + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, idx // 2),
p AS MATERIALIZED (
  SELECT d.lang, d.rank, t.lvl, d.rank >> t.lvl & 1 AS bit, t.node FROM d JOIN t ON d.lang IS NOT DISTINCT FROM t.lang AND t.idx = xor(d.rank >> t.lvl, 1)
  UNION ALL
  SELECT d.lang, d.rank, s.height + u.lvl, s.pos >> u.lvl & 1, u.node FROM d JOIN s ON d.lang IS NOT DISTINCT FROM s.lang JOIN u ON u.idx = xor(s.pos >> u.lvl, 1)),
q AS (SELECT lang, rank, sha256(string_agg(node, '' ORDER BY lvl)) AS proof FROM p GROUP BY lang, rank),
f(lang, rank, lvl, node) AS (
  SELECT lang, rank, 0, seen FROM d
  UNION ALL
  SELECT f.lang, f.rank, f.lvl + 1, sha256(CASE WHEN p.bit = 1 THEN p.node ELSE '' END || f.node || CASE WHEN p.bit = 0 THEN p.node ELSE '' END)
  FROM f JOIN (SELECT lang, height + (SELECT max(lvl) FROM u) AS top FROM s) x ON f.lang IS NOT DISTINCT FROM x.lang
  LEFT JOIN p ON f.lang IS NOT DISTINCT FROM p.lang AND f.rank = p.rank AND f.lvl = p.lvl WHERE f.lvl < x.top)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM d JOIN s ON d.lang IS NOT DISTINCT FROM s.lang CROSS JOIN (SELECT node AS root FROM u WHERE n = 1)
JOIN (SELECT lang, rank, arg_max(node, lvl) AS folded_root FROM f GROUP BY lang, rank) g ON d.lang IS NOT DISTINCT FROM g.lang AND d.rank = g.rank
LEFT JOIN q ON d.lang IS NOT DISTINCT FROM q.lang AND d.rank = q.rank
"""
