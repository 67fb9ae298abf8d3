"""Connected components as alternating large-star and small-star joins, cut by a checkpoint each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvec.llm.common import cut


def _smallest(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the smallest neighbour of u, u itself included."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    near = _smallest(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    hung = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two columns of one sortable type); root is the smallest node
    that can be reached. Loops and repeated edges are harmless; no edges give no rows. Each round leaves at
    most as many edges as before, about the logarithm of the longest path in rounds; a node with very many
    neighbours is one skewed join key, which adaptive execution splits, never one group in memory."""
    a, b = edges.columns
    now = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        now = cut(_small_star(_large_star(now)))
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
