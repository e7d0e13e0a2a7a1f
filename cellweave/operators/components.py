"""Connected components by alternating star operations, with no task that holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.runtime import cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for ``edges(a, b)``; the component is named by its smallest node.

    Each round links every larger neighbour to the smallest one around a node
    (large star), then every smaller neighbour (small star). Minima are partial
    aggregates, so a node with a third of all edges is combined before the
    shuffle, and the join back to its edges can be split by the adaptive planner.
    Rounds grow with the logarithm of the longest chain. Self-loops give a
    component of one; nulls are left out; repeated edges count once.
    """
    usable = edges.select("a", "b").where("a is not null and b is not null")
    nodes = usable.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    current = cut(usable.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = None
    for _ in range(max_rounds):
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(around, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        following = cut(small.where("a <> b").distinct())
        seen = following.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        current = following
        if seen == size:
            break
        size = seen
    else:
        raise RuntimeError(f"components are not found after {max_rounds} rounds")
    return nodes.join(current.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
