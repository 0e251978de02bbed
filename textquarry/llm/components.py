"""Connected components by alternating large and small stars; links stay distributed from start to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import cut, small


def _star(both: DataFrame, large: bool) -> DataFrame:
    """both: (u, v). Each u hands its least neighbour to its larger (large star) or smaller (small star) ones."""
    sided = both if large else both.where("v < u")
    least = small(sided.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))  # combined before the shuffle
    linked = sided.join(least, "u")
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    out = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node in `links` (a, b: comparable ids); root is the least id that it reaches.

    Rounds are cut at the shared folder and end when every node hangs on its root, so a node with very many links
    costs no task more than its share: all that is taken of a node's links is their least end. Self-links and
    repeated links change nothing; no links give no rows. Tables of a round that a count shows to be small are broadcast.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        parents = small(edges.groupBy("u").agg(F.count("*").alias("n")))
        several = parents.where("n > 1").limit(1).count()
        if not several and not edges.join(parents.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = cut(_star(cut(_star(both, True)), False))
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
