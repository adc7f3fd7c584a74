"""SimHash near-dedup with pivot distance tables.

Every distinct fingerprint has a row of Hamming distances to reference
fingerprints. Two fingerprints differ in at least as many bits as any of these
distances do, so a pair whose rows differ by more than the radius anywhere is
discarded, and the bits of the others are compared. Which pairs meet at all is
left to keys: of six blocks of bits, two are equal at a radius of 4.

For near copies by shingle similarity, too far apart for such keys, pairs meet
under bands of min-hashes; the same tables, at a wide radius, discard what no
near copies can be, and the shingle sets themselves verify the survivors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from seasight.llm.common import cut, pieces, table
from seasight.llm.components import components

SHINGLE, RADIUS, PIVOTS = 4, 4, 16
#: Keys with more fingerprints are compared in blocks of about BLOCK fingerprints, which give trees of links in place of pairs.
PAIRED, BLOCK = 64, 1024
#: Of the near-dedup stage: words of a shingle, similarity, bands of min-hashes and the min-hashes of one.
STAGE_SHINGLE, STAGE_SIMILARITY, BANDS, ROWS = 5, 0.8, 16, 4
#: Bits in which sets of LEAST_SHINGLES or more may differ at that similarity: of a binomial of 64 bits at arccos(8/9)/pi each, 1e-7 lies above. Smaller sets have no such radius.
STAGE_RADIUS, LEAST_SHINGLES = 26, 32
#: Members of a large key that all others are held against, before all that is still apart meets.
STARS = 3
#: Bytes of shingles that a task verifies pairs with, about.
BLOCK_BYTES = 16 << 20
_PART = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def reference_fingerprints(n: int = PIVOTS) -> list[int]:
    """Signed 64-bit references: well-mixed hashes of 1 to n."""
    return [_signed(xxh64_intdigest(b"pivot%d" % i, 42)) for i in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included, of the text with A-Z lower-cased."""
    w = (text or "").encode().lower().split()  # on bytes: ASCII letters, and the six ASCII spaces
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(w))
    return np.array([xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """64 bits, each set where it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _PART):
        ones += np.unpackbits(h[i : i + _PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(shingle_hashes(value.as_py(), words))) for value in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


@lru_cache(1 << 17)
def _word(w: bytes) -> int:
    return xxh64_intdigest(w, 42)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of the text with A-Z lower-cased: word hashes weighed by place, mixed. Fewer words are one shingle."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h, k = np.fromiter(map(_word, w), np.uint64, len(w)), min(words, len(w))
    x = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        x = (x ^ h[i : len(w) - k + 1 + i]) * _MIX
        x ^= x >> np.uint64(29)
    return np.unique(x)


def band_keys(half: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """A key per band: its min-hashes, each the least half hash after multiplication by an odd number, mixed with the band's place."""
    least, flat = np.full(odd.size, np.iinfo(np.uint32).max, np.uint32), odd.reshape(-1, 1)
    for i in range(0, len(half), 1024):
        np.minimum(least, (flat * half[None, i : i + 1024]).min(axis=1), out=least)
    key = np.arange(1, len(odd) + 1, dtype=np.uint64)
    for x in least.reshape(odd.shape).T.astype(np.uint64):
        key = (key ^ key >> np.uint64(29)) * _MIX + x
    return key.view(np.int64)


def shingle_sets(docs: DataFrame, words: int = STAGE_SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node (the id), fp, size, same, keys, shingles: of the distinct shingles the fingerprint, the number, a digest, the band keys, and upper halves of the hashes. Texts without words have no keys."""
    kind = docs.schema[id_col].dataType.simpleString()
    odd = np.random.default_rng(7).integers(0, 2**31, (bands, rows), dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 256):
            sets = [shingle_set(value.as_py(), words) for value in b.column("text")]
            halves = [(h >> np.uint64(32)).astype(np.uint32) for h in sets]
            halves = [x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x for x in halves]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("node"),
                    pa.array([_signed(fingerprint(h)) for h in sets], pa.int64()),
                    pa.array(map(len, sets), pa.int32()),
                    pa.array([xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()),
                    pa.array([band_keys(x, odd) if len(x) else [] for x in halves], pa.list_(pa.int64())),
                    pa.array([x.view(np.int32) for x in halves], pa.list_(pa.int32())),
                ],
                names=["node", "fp", "size", "same", "keys", "shingles"],
            )

    return docs.select(F.col(id_col).alias("node"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"node {kind}, fp long, size int, same binary, keys array<long>, shingles array<int>")


def block_keys(radius: int = RADIUS, spare: int = 2) -> list[int]:
    """Masks: fingerprints within ``radius`` agree under one of them at least (``spare`` of radius + spare blocks)."""
    edges = np.linspace(0, 64, radius + spare + 1).round().astype(int)
    blocks = [sum(1 << i for i in range(a, b)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    return [_signed(sum(x)) for x in combinations(blocks, spare)]


def pivot_table(fp: Column) -> list[Column]:
    """Distances of a fingerprint to the references."""
    return [F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("int") for p in reference_fingerprints()]


def pivots_allow(a: Column, b: Column, radius: int) -> Column:
    """Whether no reference is nearer to one fingerprint than to the other by more than ``radius``."""
    out = F.lit(True)
    for x, y in zip(pivot_table(a), pivot_table(b)):
        out = out & (F.abs(x - y) <= radius)
    return out


def _forest(radius: int):
    """Of one block of a key: a forest that joins the same fingerprints as all links between them do."""
    refs = np.array(reference_fingerprints(), np.int64).view(np.uint64)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fp, node = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["node"].to_numpy()
        table = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)
        left, links = np.ones(len(fp), bool), []
        for root in range(len(fp)):
            if not left[root]:
                continue
            left[root], todo = False, [root]
            while todo:
                u = todo.pop()
                near = np.flatnonzero(left)
                near = near[np.abs(table[near] - table[u]).max(axis=1, initial=0) <= radius]
                near = near[np.bitwise_count(fp[near] ^ fp[u]) <= radius]
                left[near] = False
                links += [(node[u], v) for v in node[near].tolist()]
                todo += near.tolist()
        return pd.DataFrame(links, columns=["a", "b"])

    return run


def link(nodes: DataFrame, keyed: DataFrame, radius: int) -> DataFrame:
    """a, b: links between ``nodes`` (node, fp) that meet under a key of ``keyed`` (c, k, node, fp).

    Keys of up to PAIRED rows are joined to pairs. The rows of larger ones are
    dealt into blocks, every two blocks meet in one task, and a task returns a
    forest of links; no pair is left out.
    """
    keyed = cut(keyed)
    sizes = keyed.groupBy("c", "k").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = cut(keyed.join(sizes, ["c", "k"]).withColumn("table", F.array(*[d.cast("byte") for d in pivot_table(F.col("fp"))])))
    few = keyed.filter(F.col("n") <= PAIRED)
    a, b = few.alias("a"), few.select(*[F.col(c).alias(f"{c}_") for c in few.columns])
    near = F.lit(True)
    for i in range(PIVOTS):
        near = near & (F.abs(F.get("a.table", i).cast("int") - F.get("table_", i).cast("int")) <= radius)
    near = (F.col("a.node") < F.col("node_")) & near & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("fp_"))) <= radius)
    pairs = a.join(b, (F.col("a.c") == F.col("c_")) & (F.col("a.k") == F.col("k_")) & near).select(F.col("a.node").alias("a"), F.col("node_").alias("b")).distinct()
    many = keyed.filter(F.col("n") > PAIRED).select("c", "k", "node", "fp", F.ceil(F.col("n") / BLOCK).alias("m"))
    many = many.withColumn("g", F.pmod(F.xxhash64("fp", "node"), F.col("m")))
    many = many.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))).select("c", "k", F.least("g", "with").alias("i"), F.greatest("g", "with").alias("j"), "node", "fp")
    kind = nodes.schema["node"].dataType.simpleString()
    return pairs.union(many.groupBy("c", "k", "i", "j").applyInPandas(_forest(radius), f"a {kind}, b {kind}"))


def may_be_near(similarity: float, a: str = "a", b: str = "b") -> Column:
    """What sizes and, of sets that have a radius, pivots and bits allow; a and b are aliases of rows with fp and size."""
    c = F.col
    small = F.least(f"{a}.size", f"{b}.size")
    sizes = small >= similarity * F.greatest(f"{a}.size", f"{b}.size") - 1e-9
    bits = pivots_allow(c(f"{a}.fp"), c(f"{b}.fp"), STAGE_RADIUS) & (F.bit_count(c(f"{a}.fp").bitwiseXOR(c(f"{b}.fp"))) <= STAGE_RADIUS)
    return sizes & ((small < LEAST_SHINGLES) | bits)


def _alike(similarity: float):
    """Of a block's pairs those whose sets are as similar as that."""

    def run(pairs: pa.Table, held: pa.Table) -> pa.Table:
        lists = held.column("shingles").combine_chunks()
        at = {n: i for i, n in enumerate(held.column("node").to_pylist())}
        values, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        sizes = np.diff(ends, prepend=0)
        own = [codes[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
        a, b = (np.array([at[x] for x in pairs.column(c).to_pylist()], int) for c in "ab")
        order, good = np.argsort(a, kind="stable"), np.zeros(len(a), bool)
        mark = np.zeros(len(values), bool)
        for part in np.split(order, np.flatnonzero(np.diff(a[order])) + 1) if len(order) else ():
            u, near = a[part[0]], b[part]
            mark[own[u]] = True
            shared = np.add.reduceat(mark[np.concatenate([own[v] for v in near.tolist()])], np.concatenate([[0], np.cumsum(sizes[near])[:-1]]), dtype=int)
            mark[own[u]] = False
            good[part] = shared >= similarity * (sizes[u] + sizes[near] - shared) - 1e-9
        return pairs.select(["a", "b"]).filter(pa.array(good))

    return run


def _between(similarity: float):
    """Of a block: links between its members and those that ask, if they are in different components."""
    refs = np.array(reference_fingerprints(), np.int64).view(np.uint64)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        node, asks = rows.column("node").to_pylist(), rows.column("asks").to_numpy()
        fp, size = rows.column("fp").to_numpy().view(np.uint64), rows.column("size").to_numpy()
        component = np.unique(np.array(rows.column("component").to_pylist()), return_inverse=True)[1]
        distances = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)
        lists = rows.column("shingles").combine_chunks()
        values, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        held = np.diff(ends, prepend=0)
        own = [codes[e - n : e] for e, n in zip(ends.tolist(), held.tolist())]
        mark, members, links = np.zeros(len(values), bool), np.flatnonzero(~asks), []
        for u in np.flatnonzero(asks).tolist():
            near = members[component[members] != component[u]]
            near = near[np.minimum(size[near], size[u]) >= similarity * np.maximum(size[near], size[u]) - 1e-9]
            far = (np.abs(distances[near] - distances[u]).max(axis=1, initial=0) > STAGE_RADIUS) | (np.bitwise_count(fp[near] ^ fp[u]) > STAGE_RADIUS)
            near = near[~far | (np.minimum(size[near], size[u]) < LEAST_SHINGLES)]
            if not len(near):
                continue
            mark[own[u]] = True
            shared = np.add.reduceat(mark[np.concatenate([own[v] for v in near.tolist()])], np.concatenate([[0], np.cumsum(held[near])[:-1]]), dtype=int)
            mark[own[u]] = False
            alike = near[shared >= similarity * (held[u] + held[near] - shared) - 1e-9]
            links += [(node[u], node[v]) for v in alike.tolist()]
        kind = rows.schema.field("node").type
        return pa.table({"a": pa.array([min(x) for x in links], kind), "b": pa.array([max(x) for x in links], kind)})

    return run


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: the ``pairs`` (a, b, w: shingles of both) whose sets (node, shingles) are as similar as that, by all their shingles.

    Pairs are dealt into blocks by both their nodes, as many as keep a block's
    sets to about BLOCK_BYTES, and a set goes to a block once.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    pairs = cut(pairs.groupBy("a", "b").agg(F.max("w").alias("w")))
    total = pairs.agg(F.sum("w")).first()[0]
    if not total:
        return pairs.select("a", "b")
    side = ceil(sqrt(4 * total / BLOCK_BYTES))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(side)).alias("i"), F.pmod(F.xxhash64("b"), F.lit(side)).alias("j"))
    wanted = dealt.select(F.col("a").alias("node"), F.col("i").alias("at_i"), F.col("j").alias("at_j")).union(dealt.select("b", "i", "j")).distinct()
    held = wanted.join(sets.hint("merge"), "node").select("at_i", "at_j", "node", "shingles")
    return cut(dealt.groupBy("i", "j").cogroup(held.groupBy("at_i", "at_j")).applyInArrow(_alike(similarity), f"a {kind}, b {kind}"))


def set_links(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: links that join the same ``nodes`` (node, fp, size, keys) as all links between those that share a band key do.

    Keys of up to PAIRED nodes are joined to pairs. All nodes of a larger one
    are held against STARS of them, those whose keys are shared most. Where
    that leaves a key in several components, nodes outside the largest meet all
    nodes of other components, in blocks of tasks. Pairs are made of ids,
    fingerprints and sizes; shingles are fetched for those that survive.
    """
    keyed = cut(nodes.select("node", "fp", "size", F.explode("keys").alias("k")))
    shared = keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = cut(keyed.join(shared, "k"))
    few, many = keyed.filter(F.col("n") <= PAIRED), keyed.filter(F.col("n") > PAIRED)
    met = few.alias("a").join(few.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.node") < F.col("b.node")) & may_be_near(similarity))
    pair = (F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"), (F.col("a.size").cast("long") + F.col("b.size")).alias("w"))
    pairs = met.select(*pair)
    if many.isEmpty():
        return verified(pairs, sets, similarity)
    many = cut(many.join(many.groupBy("node").agg(F.sum("n").alias("weight")), "node"))
    heaviest = F.max_by(F.struct("node", "fp", "size"), F.struct("weight", "node"))
    rest, stars = many, None
    for _ in range(STARS):
        own = cut(rest.groupBy("k").agg(heaviest.alias("s")).select("k", "s.*"))
        stars = own if stars is None else stars.union(own)
        rest = rest.join(own.select("k", "node"), ["k", "node"], "left_anti")
    met = many.alias("a").join(stars.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.node") != F.col("b.node")) & may_be_near(similarity))
    links = verified(pairs.union(met.select(*pair)), sets, similarity)
    state = many.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = state.groupBy("k").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.mode("component").alias("most")).filter("lo <> hi").select("k", "most")
    state = cut(state.join(apart, "k"))
    if state.isEmpty():
        return links
    # the members of a key and those outside its largest component are dealt into blocks, by their number and bytes
    outside = F.col("component") != F.col("most")
    blocks = lambda cond: F.greatest(F.ceil(F.sum(F.when(cond, F.col("size"))) * 4 / BLOCK_BYTES), F.ceil(F.count_if(cond) / BLOCK), F.lit(1))
    state = state.join(state.groupBy("k").agg(blocks(F.lit(True)).alias("m"), blocks(outside).alias("u")), "k")
    deal, copies = (lambda m: F.pmod(F.xxhash64("node"), F.col(m))), (lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1)))
    one = state.withColumn("i", deal("m")).withColumn("j", copies("u")).withColumn("asks", F.lit(False))
    other = state.filter(outside).withColumn("i", copies("m")).withColumn("j", deal("u")).withColumn("asks", F.lit(True))
    dealt = one.union(other).select("k", "i", "j", "asks", "node", "fp", "size", "component").join(sets.hint("merge"), "node")
    kind = nodes.schema["node"].dataType.simpleString()
    found = dealt.groupBy("k", "i", "j").applyInArrow(_between(similarity), f"a {kind}, b {kind}")
    return links.union(cut(found.distinct()))


def near_groups(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id.

    Fingerprints that differ in at most ``radius`` bits are linked, and
    component_id is the smallest doc_id reachable. A text of fewer words than a
    shingle is one shingle; one without words, or null, has fingerprint zero,
    which is linked like any other. A null doc_id is linked but names no
    component unless all its component's are null. Repeated rows each count.
    """
    fps = cut(fingerprints(docs, words, id_col, text_col))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")).select("fp", "first", F.col("fp").alias("node")))
    keyed = nodes.select("node", "fp", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for c, m in enumerate(block_keys(radius))])).alias("x")).select("x.c", "x.k", "node", "fp")
    comp = components(link(nodes, keyed, radius))
    of = nodes.join(comp, "node", "left").select("fp", "first", F.coalesce("component", "node").alias("comp"))
    least = of.groupBy("comp").agg(F.min("first").alias("component_id"))
    of = of.join(least, "comp").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, words: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node, component: ids of documents that have near copies, with the smallest id among those that they reach.

    Near copies share at least ``similarity`` of their distinct word shingles.
    Texts of equal sets are one node. Nodes meet under bands of min-hashes
    (``(1 - similarity ** ROWS) ** BANDS`` of pairs at the similarity don't:
    2e-4), pivots and bits discard pairs that can't be near, and all shingles
    verify the others. Null ids and texts without words have no near copies;
    rows that repeat an id are one document; an empty table gives no rows.
    """
    sets = cut(shingle_sets(docs.filter(F.col(id_col).isNotNull()), words, id_col=id_col, text_col=text_col))
    slim = sets.filter("size > 0").select("node", "fp", "size", "same", "keys")
    # a table of its own, so that the join can split a set that very many rows have
    nodes = cut(slim.groupBy("same").agg(F.min("node").alias("first"), *[F.first(c).alias(c) for c in ("fp", "size", "keys")]))
    copies = slim.select("node", "same").join(nodes.select("same", "first"), "same").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = set_links(nodes.select(F.col("first").alias("node"), "fp", "size", "keys"), sets.select("node", "shingles"), similarity)
    return components(links.union(copies))


def drop_near_copies(docs: DataFrame, words: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group of ``near_copies``.

    Rows without an id stay, and so do texts without words; rows that repeat an
    id stay or go together, and columns of ``docs`` may have any names.
    """
    comp = near_copies(docs, words, similarity, id_col, text_col)
    gone = comp.filter("node <> component").select(F.col("node").alias(id_col))
    return docs.join(gone, id_col, "left_anti").select(docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
