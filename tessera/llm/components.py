"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import settle


def components(links: DataFrame) -> DataFrame:
    """Of every node that has a link (columns a, c) the smallest node that links reach: node, root.

    Every node points to its smallest known neighbour. A round turns the other links of a node into links among those
    that it points to, and moves each pointer on to its target's target; chains shrink to half in each round, and a
    node with many neighbours is the target of pointers, which no task gathers: the join on targets is one of two
    shuffled tables, of which Spark splits the hot parts. Settled in the shared folder each round.
    """
    edges = settle(links.where("a <> c").select(F.greatest("a", "c").alias("u"), F.least("a", "c").alias("v")).distinct())
    while True:
        parent = settle(edges.groupBy("u").agg(F.min("v").alias("p"), F.count(F.lit(1)).alias("n")))
        hop = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        moved = parent.join(hop.hint("merge"), "p", "left").select("u", "p", F.coalesce("pp", "p").alias("root"), "n", F.col("pp").isNotNull().alias("on"))
        moved = settle(moved)
        open_, = moved.agg(F.sum(F.when((F.col("n") > 1) | F.col("on"), 1).otherwise(0))).first()
        if not open_:
            return moved.select(F.col("u").alias("node"), "root")
        rest = edges.join(moved.where("n > 1").select("u", "p"), "u").where(F.col("v") != F.col("p")).select(F.col("v").alias("u"), F.col("p").alias("v"))
        edges = settle(moved.select("u", F.col("root").alias("v")).union(rest).distinct())
