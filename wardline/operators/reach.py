"""Shortest travel times over a directed graph of measured routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.session import cut, release


def best_edges(routes: DataFrame, source: str, target: str, minutes: str) -> DataFrame:
    """``src, dst, minutes``: the least valid time of each directed pair; nulls, negative and infinite times and loops are no edges."""
    t = F.col(minutes)
    ok = F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != F.col(target)) & (t >= 0) & (t < float("inf"))
    return routes.where(ok).groupBy(F.col(source).alias("src"), F.col(target).alias("dst")).agg(F.min(t).alias("minutes"))


def reach(edges: DataFrame, sources: DataFrame, legs: int | None = None, rounds: int = 10_000) -> DataFrame:
    """``node, minutes``: least time from any source (column ``node``) over at most ``legs`` edges.

    Min-plus relaxation: only nodes that got better in a round send along their edges in
    the next. Without ``legs`` it goes on until nothing gets better; that more than
    ``rounds`` would be needed is an error. Unreachable nodes are absent. One row per node, whatever the number of sources.
    """
    edges = cut(edges)
    known = cut(sources.where(F.col("node").isNotNull()).select("node").distinct().withColumn("minutes", F.lit(0.0)))
    better, before = known, known
    for _ in range(legs if legs is not None else rounds):
        sent = better.join(edges.withColumnRenamed("minutes", "leg"), better.node == edges.src).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("minutes") + F.col("leg")).alias("offer"))
        both = cut(known.join(sent, "node", "full").select("node", F.least("minutes", "offer").alias("minutes"), (F.col("minutes").isNull() | (F.col("offer") < F.col("minutes"))).alias("moved")))
        known, better = both.select("node", "minutes"), both.where("moved").select("node", "minutes")
        release(before)
        before = both
        if better.isEmpty():
            break
    else:
        if legs is None:
            raise RuntimeError(f"travel times still get better after {rounds} rounds")
    return known
