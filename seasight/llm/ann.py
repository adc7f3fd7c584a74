"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

NN-descent keeps, for every vector, its best neighbours so far. A round joins
each vector's list, both ways, with the vectors in it, compares those of its
neighbours of which one at least is new, and offers each what beats its worst
neighbour; it ends when hardly any list changes. A query then walks the graph
from its own vector and from a few of its own direction: the best candidates
that were not yet expanded are, a few rounds long. Between the two, vectors
travel as bytes, each at its own scale; what is returned is scored in double
precision on the originals.

A large product means near only among vectors of like length. One more component
evens lengths out, and vectors far longer than most have graphs of their own, by
powers of four, so that they don't make all others look alike; a query walks
them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seasight.llm.common import cut, table

NEIGHBOURS, ROUNDS, OFFERS = 48, 8, 6
#: Rounds end when fewer than this share of all neighbours are new.
SETTLED = 0.01
#: Orders by random projections that the first neighbours come from, the vectors of a stretch, and the offers in one.
ORDERS, STRETCH, FIRST, SIGNS = 4, 128, 10, 8
#: Of the search: candidates kept, rounds, candidates that an expanded vector offers, and vectors of each cell of directions, and of each tier, that queries start from.
BEAM, HOPS, SHOWN, STARTS, LEADS = 128, 4, 24, 8, 64
TOP, EVERY = 20, 20


def usable(c):
    """A vector that takes part: not null, not zero, every component there and finite."""
    big = float(np.finfo(np.float64).max)
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= big)) & F.exists(c, lambda x: x != 0)


def _codes(nodes: DataFrame) -> DataFrame:
    """id, tier, code: components as signed bytes, their scale, and a component that makes all lengths of the tier equal, so that near means a large product.

    Tier 0 reaches to twice the length that 99 % of the vectors stay below, the
    next ones to four times as far each. Shorter vectors than the longest are
    filled up with zeros.
    """
    shape = nodes.agg(F.max(F.size("embedding")).alias("dim"), F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))).alias("big")).first()
    dim, big = shape["dim"] or 1, shape["big"] or 1.0
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (x.cast("double") / big) * (x.cast("double") / big)))
    most = 2 * (nodes.agg(F.percentile_approx(length, 0.99).alias("p")).first()["p"] or 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tiers, codes = [], []
            for v in b.column("embedding"):
                x = np.zeros(dim)
                own = np.asarray(v.as_py(), float) / big
                x[: len(own)] = own
                size = float(np.sqrt(x @ x))
                tier = max(0, int(np.ceil(np.log2(max(size, 1e-300) / most) / 2)))
                scale = max(float(np.abs(x).max()), 1e-30) / 127.0
                rest = np.sqrt(max(0.0, (most * 4.0**tier) ** 2 - size * size))
                tiers.append(tier)
                codes.append(np.rint(x / scale).astype(np.int8).tobytes() + np.array([scale, rest], "<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(tiers, pa.int32()), pa.array(codes, pa.binary())], names=["id", "tier", "code"])

    return nodes.select("id", "embedding").mapInArrow(run, "id long, tier int, code binary")


def _matrix(codes: pa.Array, asks: bool = False) -> np.ndarray:
    """The vectors of codes; what evens out lengths plays no part in those that ask."""
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    if not len(codes):
        return np.zeros((0, 1), np.float32)
    raw = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)
    tail = np.ascontiguousarray(raw[:, -8:]).view("<f4")
    m = np.concatenate([raw[:, :-8].view(np.int8) * tail[:, :1], tail[:, 1:]], axis=1)
    if asks:
        m[:, -1] = 0
    return m


def _offers(a: list, b: list, s: list) -> pa.RecordBatch:
    cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
    return pa.RecordBatch.from_arrays([cat(a, pa.int64()), cat(b, pa.int64()), cat(s, pa.float32())], names=["a", "b", "s"])


_EDGES = "a long, b long, s float"


def _cells(codes: DataFrame, orders: int, asks: bool = False) -> DataFrame:
    """tier, cell, along, id, code: every vector's cell of directions (by signs of projections) in each order, and how far along it is."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("code"), asks)
            for t in range(orders):
                r = np.random.default_rng(t).standard_normal((m.shape[1], SIGNS + 1)).astype(np.float32)
                p = m @ r
                cell = ((p[:, :SIGNS] > 0) << np.arange(SIGNS)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("tier"), pa.array(cell + (t << SIGNS), pa.int32()), pa.array(p[:, SIGNS], pa.float32()), b.column("id"), b.column("code")], names=["tier", "cell", "along", "id", "code"])

    return codes.select("id", "tier", "code").mapInArrow(project, "tier int, cell int, along float, id long, code binary")


def _first(placed: DataFrame, stretch: int, first: int) -> DataFrame:
    """Neighbours within stretches of the orders by random projections."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tiers, m = b.column("id").to_numpy(), b.column("tier").to_numpy(), _matrix(b.column("code"))
            a, c, s = [], [], []
            for i in range(0, len(ids), stretch):
                own, x, tier = ids[i : i + stretch], m[i : i + stretch], tiers[i : i + stretch]
                if len(own) < 2:
                    continue
                dots = np.where(tier[:, None] == tier[None, :], x @ x.T, -np.inf)
                np.fill_diagonal(dots, -np.inf)
                k = min(first, len(own) - 1)
                best = np.argpartition(-dots, k - 1, axis=1)[:, :k]
                v = np.take_along_axis(dots, best, 1).ravel()
                fits = v > -np.inf
                a.append(np.repeat(own, k)[fits]), c.append(own[best].ravel()[fits]), s.append(v[fits])
            yield _offers(a, c, s)

    return placed.repartitionByRange("tier", "cell", "along", "id").sortWithinPartitions("tier", "cell", "along", "id").mapInArrow(near, _EDGES).filter("a <> b")


def best(edges: DataFrame, k: int) -> DataFrame:
    """a, b, s, new: the k best neighbours of every vector, equal ones once; new where all that offer it are."""
    w = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    return edges.withColumn("r", F.dense_rank().over(w)).filter(F.col("r") <= k).groupBy("a", "b").agg(F.max("s").alias("s"), F.bool_and("new").alias("new"))


def _lists(edges: DataFrame, codes: DataFrame, k: int) -> DataFrame:
    """a, near (b, code, worst, new): every vector's neighbours, both ways; worst is what an offer to b must beat."""
    worst = edges.groupBy("a").agg(F.when(F.count("*") >= k, F.min("s")).alias("worst"))
    known = codes.join(worst, codes.id == worst.a, "left").select(F.col("id").alias("b"), "code", F.coalesce("worst", F.lit(float("-inf"))).cast("float").alias("worst"))
    both = edges.select("a", "b", "s", "new").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "s", "new"))
    return best(both, 2 * k).join(known, "b").groupBy("a").agg(F.collect_list(F.struct("b", "code", "worst", "new")).alias("near"))


def _flat(near: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StructArray]:
    x = near.flatten()
    return np.concatenate([[0], np.cumsum(near.value_lengths().to_numpy(zero_copy_only=False))]).astype(int), x.field("b").to_numpy(zero_copy_only=False), _matrix(x.field("code")), x


def _join_local(offers: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 512):
                at, ids, m, x = _flat(whole.column("near").slice(i, 512))
                worst, new = x.field("worst").to_numpy(zero_copy_only=False), x.field("new").to_numpy(zero_copy_only=False)
                a, b, s = [], [], []
                for lo, hi in zip(at[:-1], at[1:]):
                    if hi - lo < 2:
                        continue
                    dots = m[lo:hi] @ m[lo:hi].T
                    np.fill_diagonal(dots, -np.inf)
                    old = ~new[lo:hi].astype(bool)
                    dots[np.ix_(old, old)] = -np.inf  # they were compared when one of them was new
                    k = min(offers, hi - lo - 1)
                    top = np.argpartition(-dots, k - 1, axis=1)[:, :k]
                    v = np.take_along_axis(dots, top, 1)
                    r, c = np.nonzero(v > worst[lo:hi, None])
                    fits = v[r, c] > -np.inf
                    r, c = r[fits], c[fits]
                    a.append(ids[lo:hi][r]), b.append(ids[lo:hi][top[r, c]]), s.append(v[r, c])
                yield _offers(a, b, s)

    return run


def graph(codes: DataFrame, placed: DataFrame, k: int = NEIGHBOURS, rounds: int = ROUNDS, offers: int = OFFERS, settled: float = SETTLED) -> DataFrame:
    """a, near: the neighbour lists after NN-descent, ``rounds`` rounds at most."""
    edges = cut(best(_first(placed, STRETCH, FIRST).withColumn("new", F.lit(True)), k))
    for _ in range(rounds):
        lists = _lists(edges, codes, k).filter(F.exists("near", lambda x: x["new"]))
        found = lists.select("near").mapInArrow(_join_local(offers), _EDGES).withColumn("new", F.lit(True))
        edges = cut(best(edges.withColumn("new", F.lit(False)).union(found), k))
        news, everything = edges.agg(F.count_if("new"), F.count("*")).first()
        if news <= settled * everything:
            break
    return cut(_lists(edges, codes, k).select("a", "near"))


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of queries at a vector of the graph: the best of its neighbours, if they beat what the query keeps already."""
    for whole in batches:
        for i in range(0, len(whole), 512):
            part = whole.slice(i, 512)
            at, ids, m, _ = _flat(part.column("near"))
            q, least, own, shown = _matrix(part.column("q_code"), True), part.column("least").to_numpy(zero_copy_only=False), part.column("q").to_numpy(), part.column("shown").to_numpy()
            a, b, s = [], [], []
            for n, (lo, hi) in enumerate(zip(at[:-1], at[1:])):
                dots = m[lo:hi] @ q[n]
                keep = np.argsort(-dots)[: shown[n]]
                keep = keep[(dots[keep] > least[n]) & (ids[lo:hi][keep] != own[n])]
                a.append(np.full(len(keep), own[n])), b.append(ids[lo:hi][keep]), s.append(dots[keep])
            yield _offers(a, b, s)


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("q"), b.column("id"), pa.array((_matrix(b.column("q_code"), True) * _matrix(b.column("code"))).sum(axis=1), pa.float32())], names=["a", "b", "s"])


def starts(placed: DataFrame, codes: DataFrame, asked: DataFrame, each: int = STARTS, leads: int = LEADS) -> DataFrame:
    """q, b, s: vectors of the query's own cells of directions, ``each`` of a cell (the smallest ids), and ``leads`` of every tier."""
    w = Window.partitionBy("tier", "cell").orderBy("id")
    some = placed.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= each).select("cell", "id", "code")
    own = asked.select(F.col("q").alias("id"), F.lit(0).alias("tier"), F.col("q_code").alias("code"))
    near = _cells(own, ORDERS, True).select(F.col("id").alias("q"), F.col("code").alias("q_code"), "cell").join(some, "cell").select("q", "q_code", "id", "code")
    first = codes.withColumn("r", F.row_number().over(Window.partitionBy("tier").orderBy(F.xxhash64("id"), "id"))).filter(F.col("r") <= leads).select("tier", "id", "code")
    tiers = [r["tier"] for r in codes.select("tier").distinct().collect()]  # a row per power of four of the lengths
    lead = asked.withColumn("tier", F.explode(F.array(*[F.lit(t) for t in tiers]) if tiers else F.expr("cast(array() as array<int>)"))).join(first, "tier").select("q", "q_code", "id", "code")
    return near.union(lead).filter("q <> id").mapInArrow(_score, _EDGES).groupBy(F.col("a").alias("q"), "b").agg(F.max("s").alias("s"))


def search(lists: DataFrame, codes: DataFrame, placed: DataFrame, queries: DataFrame, beam: int = BEAM, hops: int = HOPS, shown: int = SHOWN) -> DataFrame:
    """q, b, s: up to ``beam`` vectors that the walk of each query (q, an id of the graph) found."""
    asked = cut(queries.join(codes, queries.q == codes.id).select("q", F.col("code").alias("q_code")))
    kept = cut(starts(placed, codes, asked).withColumn("done", F.lit(False)))
    every = asked.select("q", F.col("q").alias("node"), "q_code", F.lit(float("-inf")).cast("float").alias("least"), F.lit(2**30).alias("shown"))
    for hop in range(hops):
        least = kept.groupBy("q").agg(F.when(F.count("*") >= beam, F.min("s")).alias("least"))
        front = kept.filter("not done").join(asked, "q").join(least, "q").select("q", F.col("b").alias("node"), "q_code", F.coalesce("least", F.lit(float("-inf"))).cast("float").alias("least"), F.lit(shown).alias("shown"))
        front = front if hop else front.union(every)
        found = front.join(lists, front.node == lists.a).select("q", "q_code", "least", "shown", "near").mapInArrow(_expand, _EDGES)
        found = kept.withColumn("done", F.lit(True)).union(found.select(F.col("a").alias("q"), "b", "s", F.lit(False).alias("done")))
        merged = found.groupBy("q", "b").agg(F.max("s").alias("s"), F.max("done").alias("done"))
        ranked = merged.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "b"))).filter(F.col("r") <= beam)
        kept = cut(ranked.select("q", "b", "s", "done"))
    return kept.select("q", "b", "s")


def nearest(vectors: DataFrame, queries, top: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for the rows that ``queries`` (a condition) picks, the ``top`` largest inner products found.

    Every row but the query's own is a candidate. Equal vectors are one vector
    of the graph; its ``top`` + 1 smallest ids stand for it, which is all that
    ties to the smaller id can ask for. Vectors that are null, zero, or hold
    null or non-finite components take no part, nor do rows without an id;
    of rows that repeat an id the largest vector counts. Of vectors of unequal lengths
    the shorter one counts as filled up with zeros. Other columns aren't looked
    at. No usable vector: an empty result.
    """
    v = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), queries.alias("asks"))
    v = v.groupBy("vec_id").agg(F.max("embedding").alias("embedding"), F.bool_or("asks").alias("asks"))
    groups = v.groupBy("embedding").agg(F.min("vec_id").alias("id"))
    nodes = cut(groups.select("id", "embedding"))
    rows = cut(v.join(nodes, "embedding").select("vec_id", "id", "asks"))
    codes = cut(_codes(nodes))
    placed = cut(_cells(codes, ORDERS))
    asking = rows.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("id").alias("q"))
    found = search(graph(codes, placed, **how), codes, placed, asking.select("q").distinct())
    # more than asked for go on, so that the originals decide
    few = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "b"))).filter(F.col("r") <= 3 * top).select("q", "b")
    few = few.union(asking.select("q", F.col("q").alias("b")).distinct())
    left, right = nodes.select(F.col("id").alias("q"), F.col("embedding").alias("x")), nodes.select(F.col("id").alias("b"), F.col("embedding").alias("y"))
    product = F.aggregate(F.zip_with("x", "y", lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, z: s + z)
    scored = cut(few.join(left, "q").join(right, "b").select("q", "b", product.alias("score")))
    members = rows.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).filter(F.col("n") <= top + 1).select(F.col("id").alias("b"), "vec_id")
    out = asking.join(scored, "q").join(members, "b").filter("vec_id <> query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
