"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdtide.sources.storage import settle


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("b").alias("a"), F.col("a").alias("b"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, least): every linked node and the least node of its component.

    ``edges``: columns a, b. Alternating large-star and small-star steps: each hangs neighbours below their least one, by
    an aggregation and a join, so a node with very many neighbours is never gathered into a row. Every step is stored;
    the loop ends when a step changes nothing.
    """
    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        both = edges.unionByName(_turned(edges))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours go below the least neighbour
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = settle(large, "large_star")
        # small star: smaller neighbours and the node itself go below the least one
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        edges = settle(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "small_star")
        after = state(edges)
        if after == before:
            break
        before = after
    parents = edges.groupBy("a").agg(F.min("b").alias("b"))
    roots = edges.select("b").distinct()
    return parents.select(F.col("a").alias("node"), F.col("b").alias("least")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("least")))
