"""Connected components by alternating stars, as joins and aggregates with a reliable checkpoint each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import checkpointed


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every end of the edges (a, b), component being the least node reachable.

    Edges may repeat and point either way; loops and null ends are ignored. Every round hangs each node's greater
    neighbours on its least neighbour, then its lesser ones, until nothing moves; the number of rounds grows with the
    logarithm of the longest chain. A hub's edges are spread by the join (skewed partitions are split at run time), and
    its least neighbour is found by partial aggregates.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    now = edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    now = checkpointed(now)
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
