"""Connected components of a distributed edge list by contraction.

In each round every node takes the least of its neighbours by a hashed order as its parent, edges move to the
parents, and equal edges and loops go. No node's neighbours are gathered: minima are aggregated before the shuffle,
and the joins have both sides exchanged, so that adaptive execution can split a hot node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.session import checkpointed, scratch


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a, b) of longs to (node, root) for all nodes with an edge to another; root is the same in a component.

    Loops, repeated edges and both directions are allowed; an empty table gives an empty one.
    """
    with scratch(edges.sparkSession) as kept:
        e = kept(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        maps = []
        for nth in range(most_rounds):
            if e.isEmpty():
                break
            maps.append(_parents(e, nth, kept))
            e = kept(_moved(e, maps[-1]))
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        if not maps:
            return checkpointed(e.select(F.col("a").alias("node"), F.col("b").alias("root")))
        # In the last round every component is a star; back from there to the nodes of the first.
        roots = maps[-1].withColumnRenamed("parent", "root")
        for parent in reversed(maps[:-1]):
            above = roots.select(F.col("node").alias("parent"), "root")
            roots = kept(parent.join(above, "parent", "left").select("node", F.coalesce("root", "parent").alias("root")))
        return checkpointed(roots)


def _parents(e: DataFrame, nth: int, kept) -> DataFrame:
    """node and parent: the least neighbour in the round's hashed order, or the node itself where it is the least."""

    def order(c: str):
        return F.struct(F.xxhash64(F.lit(nth), F.col(c)).alias("place"), F.col(c).alias("b"))

    near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.min(order("b")).alias("m"))
    own = F.when(F.col("m") < order("a"), F.col("m")["b"]).otherwise(F.col("a"))
    return kept(least.select(F.col("a").alias("node"), own.alias("parent")))


def _moved(e: DataFrame, parent: DataFrame) -> DataFrame:
    left = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
    right = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
    moved = e.join(left, "a").join(right, "b").where("pa != pb")
    return moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
