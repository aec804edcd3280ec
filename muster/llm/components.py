"""Connected components of links between 64-bit numbers, by joins and shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from muster.functions.common import lookup_join
from muster.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every number in ``links`` (columns ``a``, ``b``); the root is the component's smallest.

    Every round points the larger neighbours of each number at its smallest neighbour, then the
    smaller ones (large-star and small-star); the number of rounds grows with the logarithm of the
    longest chain. Rows stay links: no group of neighbours is ever collected. The links of
    a round are cut from their lineage by a checkpoint in the shared folder.
    """
    edges = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: neighbours above a node are linked to the smallest around it.
        large = both.filter("b > a").select(F.col("a").alias("k"), "b")
        large = lookup_join(large, lowest.select(F.col("a").alias("k"), "m"), ["k"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = lookup_join(large.select(F.col("a").alias("k"), "b"), least.select(F.col("a").alias("k"), "m"), ["k"])
        stars = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = checkpointed(stars.distinct())
        # Done when every node has one parent and no parent has a parent.
        state = after.agg(F.count("*").alias("n"), F.countDistinct("a").alias("nodes")).first()
        if state["n"] == state["nodes"]:
            parents = after.select("b").distinct()
            if after.join(parents.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
                break
        edges = after
    roots = after.select(F.col("b").alias("node")).distinct()
    return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
