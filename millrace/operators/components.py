"""Connected components by alternating large-star and small-star contraction.

Every round is two aggregations and two equi-joins on the vertex, so no vertex's neighbours
ever meet in one task, and adaptive execution can split the joins of a hub.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.storage import cut


def _digest(edges: DataFrame) -> tuple:
    def fold(seed: int) -> Column:
        return F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(20,0)"))

    return tuple(edges.agg(F.count("*"), fold(1), fold(2)).first())


def _star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Return ``(vertex, component)`` for every vertex of ``edges``; component is its smallest vertex.

    Edges are undirected. Edges with a null end are ignored, self-loops yield a component of their
    own vertex, repeated edges change nothing, an empty table gives an empty result.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    loops = pairs.where("a = b").select(F.col("a").alias("vertex"), F.col("a").alias("component"))
    now = cut(pairs.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _digest(now)
    for _ in range(max_rounds):
        now = cut(_star(now))
        if (after := _digest(now)) == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return members.union(roots).union(loops).groupBy("vertex").agg(F.min("component").alias("component"))
