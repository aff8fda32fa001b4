"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.session import cut, release


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """``node, class_id`` of every node in ``links`` (``a, b``); the class is its smallest node.

    Each round points all larger neighbours of a node, then all its smaller ones, to the
    smallest known; the number of rounds grows with the logarithm of the longest chain.
    A node with very many links is one group row per link, reduced by a minimum, never
    collected. Links with nulls are ignored. That more than ``rounds`` would be needed is an error.
    """
    edges = cut(links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").where(F.col("b") != F.col("m")).select("b", "m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, cut(small.unionByName(small_least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct())
        release(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"classes still grow after {rounds} rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("class_id")).withColumnRenamed("a", "node")
    heads = roots.select(F.col("class_id").alias("node"), "class_id").distinct()
    return roots.unionByName(heads)
