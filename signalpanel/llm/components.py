"""Connected components of a graph that need not fit in any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest reachable node) of every node of `edges` (columns a, b: long).

    Alternating large-star and small-star steps (Kiveris et al., 2014): every node hooks
    its neighbours to its smallest one. Grouped minima are pre-aggregated and a hub's edges
    are joined, not grouped, so no node's neighbours meet in one task. Loops, repeated and
    null edges are dropped; each round is checkpointed."""
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = saved(e)
    for _ in range(rounds):
        # large star: each node hooks its larger neighbours to the smallest of its neighbours and itself
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node hooks its smaller neighbours, and itself, to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        # done when every node has one parent and no parent has a parent: a star forest
        stars = small.groupBy("u").count().where("count > 1").limit(1).count() == 0
        if stars and small.select("u").join(small.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count() == 0:
            e = small
            break
        e = small
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
