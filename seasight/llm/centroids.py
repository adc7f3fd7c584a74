"""Centroid clustering over an incremental matrix of exact dot products.

Components become integers, so that every sum is exact and no result depends
on how rows are dealt. A vector's dot products with all centroids are written
with it; a round adds only the products with those components of a centroid
that changed, and takes the nearest centroid anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasight.llm.common import cut, free_name, pieces, table

DIM, K, ROUNDS, SCALE = 64, 16, 3, 64
#: Integers up to this have dot products and distances of DIM components that fit in 64 bits.
LARGEST = 1 << 27
_MATRIX = "x array<int>, norm long, dots array<long>, cluster int, distance long"


def integers(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, x: floor(scale * component) of the vectors of exactly ``dim`` components, none of them null or not finite."""
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.size("v") == dim)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.filter(finite).select("vec_id", F.transform("v", lambda x: F.floor(x * float(scale))).alias("w"))
    fits = F.forall("w", lambda x: x.between(-LARGEST, LARGEST))
    return v.select("vec_id", F.when(fits, F.col("w").cast("array<int>")).otherwise(F.raise_error(F.lit(f"a scaled component is beyond {LARGEST}"))).alias("x"))


def seeds(ints: DataFrame, k: int = K, seed: int = 1) -> np.ndarray:
    """The vectors of the k smallest sha256 of ``seed:vec_id``, in that order; rows without an id are none, and rows of one id go by their components."""
    first = ints.filter("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy("h", "x").limit(k)
    return np.array([r["x"] for r in first.select("x").collect()], np.int64)


def _nearest(dots: np.ndarray, norm: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = norm[:, None] - 2 * dots + (centroids * centroids).sum(axis=1)[None, :]
    at = d.argmin(axis=1)  # the first of equal ones
    return at, d[np.arange(len(d)), at]


def _lists(flat: np.ndarray, width: int, kind: pa.DataType) -> pa.Array:
    rows = len(flat) // width if width else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(flat, kind))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _start(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for x in batches for p in pieces([x], 4096)):
            x = _matrix(b.column("x"), centroids.shape[1])
            yield _rows(b.column("vec_id"), x, (x * x).sum(axis=1), x @ centroids.T, centroids)

    return run


def _update(old: np.ndarray, new: np.ndarray):
    """Adds to each dot product what the changed components of its centroid make."""
    moved = [(c, np.flatnonzero(new[c] != old[c])) for c in range(len(new))]
    steps = [(c, at, (new - old)[c, at]) for c, at in moved if len(at)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for x in batches for p in pieces([x], 4096)):
            x, dots = _matrix(b.column("x"), new.shape[1]), _matrix(b.column("dots"), len(new)).copy()
            for c, at, by in steps:
                dots[:, c] += x[:, at] @ by
            yield _rows(b.column("vec_id"), x, b.column("norm").to_numpy(), dots, new)

    return run


def _rows(ids: pa.Array, x: np.ndarray, norm: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> pa.RecordBatch:
    at, d = _nearest(dots, norm, centroids)
    cols = [ids, _lists(x.ravel(), x.shape[1], pa.int32()), pa.array(norm, pa.int64()), _lists(dots.ravel(), dots.shape[1], pa.int64()), pa.array(at, pa.int32()), pa.array(d, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=["vec_id", "x", "norm", "dots", "cluster", "distance"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows a row per cluster: their number and the sums of their components."""
    sums: dict[int, np.ndarray] = {}
    counts: dict[int, int] = {}
    for b in batches:
        x, at = _matrix(b.column("x"), len(b.column("x")[0])), b.column("cluster").to_numpy()
        for c in np.unique(at).tolist():
            mine = x[at == c]
            sums[c], counts[c] = sums.get(c, 0) + mine.sum(axis=0), counts.get(c, 0) + len(mine)
    keys = sorted(sums)
    flat = np.concatenate([sums[c] for c in keys]) if keys else np.zeros(0, np.int64)
    width = len(flat) // len(keys) if keys else 0
    lists = _lists(flat, width, pa.int64()) if keys else pa.array([], pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([counts[c] for c in keys], pa.int64()), lists], names=["cluster", "n", "sums"])


def moved(matrix: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the componentwise floor of its vectors' mean; one without vectors stays.

    Tasks add up their own rows, Spark adds the sums: K x DIM numbers come to the driver, however many vectors there are.
    """
    parts = matrix.select("x", "cluster").mapInArrow(_sums, "cluster int, n long, sums array<long>")
    parts = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in parts.collect():
        out[r["cluster"], r["i"]] = r["s"] // r["n"]
    return out


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = 1, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector kept: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of another length, null ones and those with null or non-finite
    components are left out. A component x counts as floor(scale * x); beyond
    2^27 that is an error, as squared distances would not fit in 64 bits. Rows
    without an id are clustered but are no first centroid; repeated rows each
    count; of fewer vectors than k each id's is a centroid; ties go to the
    smaller number. Where no vector has an id there is no centroid, and all
    but vec_id is null. An empty table gives no rows, and other columns are not
    looked at.
    """
    ints = cut(integers(vectors, dim, scale, id_col, vec_col))
    kind = ints.schema["vec_id"].dataType.simpleString()
    centroids = seeds(ints, k, seed)
    if not len(centroids):
        return ints.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    matrix = cut(ints.mapInArrow(_start(centroids), f"vec_id {kind}, {_MATRIX}"))
    for _ in range(rounds):
        new = moved(matrix, centroids)
        if (new == centroids).all():
            break
        matrix, centroids = cut(matrix.mapInArrow(_update(centroids, new), f"vec_id {kind}, {_MATRIX}")), new
    per = {r["cluster"]: r["s"] for r in matrix.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    said = F.create_map(*[y for c in per for y in (F.lit(c), F.struct(F.lit(per[c]).cast("long").alias("cluster_inertia"), F.lit(sum(per.values())).cast("long").alias("inertia"), F.lit(digests[c]).alias("centroid_sha256")))])
    return matrix.select("vec_id", "cluster", "distance", said[F.col("cluster")].alias(free_name("said", matrix))).select("vec_id", "cluster", "distance", "said.*")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _round(n: int) -> str:
    """SQL: assignments ``a{n}`` to centroids ``c{n}``, and the centroids that they make."""
    nearest = f"""
a{n} AS MATERIALIZED (SELECT row_no, CAST(x[1].c AS INT) AS cluster, CAST(x[1].d AS BIGINT) AS distance FROM (
  SELECT row_no, list(struct_pack(d := d, c := c) ORDER BY d, c) AS x FROM (
    SELECT p.row_no, q.c, CAST(sum((p.x - q.x) * (p.x - q.x)) AS BIGINT) AS d FROM p JOIN c{n} q USING (i) GROUP BY p.row_no, q.c) GROUP BY row_no))"""
    means = f""",
s{n} AS (SELECT cluster AS c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM p JOIN a{n} USING (row_no) GROUP BY 1, 2),
c{n + 1} AS MATERIALIZED (SELECT q.c, q.i, CASE WHEN n IS NULL THEN q.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{n} q LEFT JOIN s{n} USING (c, i))"""
    return nearest + (means if n < ROUNDS else "")


OP11_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row_no, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda y: isfinite(y))) = {DIM}),
p AS MATERIALIZED (SELECT row_no, i, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT row_no, embedding, unnest(range(1, {DIM + 1})) AS i FROM v)),
k AS (SELECT row_no, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM v WHERE vec_id IS NOT NULL ORDER BY c LIMIT {K}),
c0 AS MATERIALIZED (SELECT c, i, x FROM k JOIN p USING (row_no)),{",".join(_round(n) for n in range(ROUNDS + 1))},
g AS (SELECT c AS cluster, sha256(string_agg(x, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN v USING (row_no) JOIN g USING (cluster)
"""
