"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasight.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges`` (a, b).

    Every node hooks to its smallest neighbour, chains are shortened, and the
    graph is contracted to what the nodes hook to: at least half the nodes of
    each component go in every round. Rounds are cut into the shared folder.
    """
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    labels = None
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        p = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p")))
        for _ in range(2):
            q = p.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            p = p.join(q, "p").select("node", F.col("pp").alias("p"))
        p = cut(p)
        pa, pb = p.select(F.col("node").alias("a"), F.col("p").alias("x")), p.select(F.col("node").alias("b"), F.col("p").alias("y"))
        e = cut(e.join(pa, "a").join(pb, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct())
        if labels is None:
            labels = p
        else:
            up = p.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            labels = cut(labels.join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("p")))
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("p").alias("component"))
