"""Exact dedup by content-defined chunk recipes.

Every text is cut where a rolling hash of its UTF-8 bytes says so. Only chunk
digests leave the task that read the text: a short key, and the chunk's length
with a strong digest of another kind, which tell apart chunks whose short keys
collide. The distinct chunks are numbered per key, which makes them verified
identifiers; a text is then its ordered list of identifiers, and texts are equal
when their lists are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from seasight.llm.common import cut, table

#: Cut points are a function of the 16 bytes before them.
WINDOW = 16
MIN_BYTES, MAX_BYTES, MEAN_BITS = 256, 16384, 10

_GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)


def chunk_ends(data: bytes, min_bytes: int = MIN_BYTES, max_bytes: int = MAX_BYTES, mean_bits: int = MEAN_BITS) -> list[int]:
    """Ends of the content-defined chunks of ``data``; one end, 0, for no bytes."""
    n = len(data)
    if n <= min_bytes:
        return [n]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    span = 1
    while span < WINDOW:  # the sum over 2 * span bytes, from two sums over span
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    ends, last = [], 0
    for at in (np.flatnonzero((h >> np.uint32(32 - mean_bits)) == 0) + 1).tolist():
        while at - last > max_bytes:
            last += max_bytes
            ends.append(last)
        if at - last >= min_bytes and at < n:
            ends.append(at)
            last = at
    while n - last > max_bytes:
        last += max_bytes
        ends.append(last)
    return [*ends, n]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shas, sizes, keys, digests = [], [], [], []
        for value in b.column("text"):
            data = (value.as_py() or "").encode()
            shas.append(hashlib.sha256(data).hexdigest())
            sizes.append(len(data))
            k, d, start = [], [], 0
            for end in chunk_ends(data):
                part = data[start:end]
                k.append(_signed(xxh64_intdigest(part)))
                d.append(hashlib.blake2b(part, digest_size=16).digest() + len(part).to_bytes(4, "big"))
                start = end
            keys.append(k)
            digests.append(d)
        yield pa.RecordBatch.from_arrays(
            [b.column("row_no"), b.column("doc_id"), pa.array(shas, pa.string()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(digests, pa.list_(pa.binary()))],
            names=["row_no", "doc_id", "text_sha256", "n_bytes", "keys", "digests"],
        )


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_no, doc_id, text_sha256, n_bytes and the recipe: the ordered list of verified chunk identifiers."""
    source = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    raw = cut(source.mapInArrow(_recipes, f"row_no long, doc_id {kind}, text_sha256 string, n_bytes long, keys array<long>, digests array<binary>"))
    refs = raw.select("row_no", F.posexplode(F.arrays_zip("keys", "digests")).alias("pos", "c")).select("row_no", "pos", F.col("c.keys").alias("key"), F.col("c.digests").alias("digest"))
    chunks = refs.select("key", "digest").distinct()
    numbered = chunks.withColumn("no", F.row_number().over(Window.partitionBy("key").orderBy("digest")))
    lists = (
        refs.join(numbered, ["key", "digest"])
        .groupBy("row_no")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "key", "no"))).alias("r"))
        .select("row_no", F.transform("r", lambda x: F.struct(x["key"].alias("key"), x["no"].alias("no"))).alias("recipe"))
    )
    return raw.select("row_no", "doc_id", "text_sha256", "n_bytes").join(lists, "row_no")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_bytes, n_chunks.

    Texts are equal when identical; a null text counts as empty, and empty
    texts are equal. The row with the largest doc_id stays (a null doc_id is
    below any other); of rows that repeat this doc_id one stays. An empty table
    gives an empty result, and other columns of ``docs`` are not looked at.
    """
    rows = cut(recipes(docs, id_col, text_col))
    # a table of its own, so that the join can split a recipe that very many rows have
    groups = cut(rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "row_no")).alias("stays"), F.count("*").alias("group_size")))
    return rows.join(groups, "recipe").select(
        "doc_id",
        F.col("stays.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("stays.row_no")).alias("kept"),
        "text_sha256",
        "n_bytes",
        F.size("recipe").alias("n_chunks"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose text a document with a larger id has.

    doc_id names a document here: rows that repeat one stay or go together.
    """
    dropped = exact_groups(docs, id_col, text_col).filter("doc_id <> keep_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(dropped, id_col, "left_anti").select(docs.columns)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
