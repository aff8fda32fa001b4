"""Splitting totals: in proportion, evenly, and in whole units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share_of(total: Column, weight: Column, *group: str) -> Column:
    """``total`` in proportion to ``weight`` within the group; null where the weights add up to 0."""
    return total * F.try_divide(weight, F.sum(weight).over(Window.partitionBy(*group)))


def even_share(total: Column, *group: str) -> Column:
    return total / F.count("*").over(Window.partitionBy(*group))


def largest_remainder(df: DataFrame, weight: str, total: str, key: str, least: int = 0) -> DataFrame:
    """Whole units of ``total`` in proportion to ``weight``: floors first, the rest to the
    largest fractions (ties: the larger key). Each key gets ``least`` beforehand.

    For small sets of keys such as towns: the ranking is over all rows.
    """
    everything = Window.partitionBy()
    spare = F.col(total) - least * F.count("*").over(everything)
    quota = spare * F.col(weight) / F.sum(weight).over(everything)
    rows = df.withColumn("quota", quota).withColumn("whole", F.floor("quota")).withColumn("fraction", F.col("quota") - F.col("whole"))
    rows = rows.withColumn("left", spare - F.sum("whole").over(everything)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("fraction"), F.desc(key))))
    return rows.withColumn("units", (least + F.col("whole") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).cast("long")).drop("quota", "whole", "fraction", "left", "place")


def observed_or_share(df: DataFrame, observed: str, total: str, weight: str) -> DataFrame:
    """Adds ``amount``: what was observed, else the row's part of ``total`` by its weight among all rows, and ``basis``.

    The weights are summed apart and joined as one row, so that no task holds all rows.
    """
    weights = df.agg(F.sum(weight).alias("__all"))
    shared = F.col(total) * F.try_divide(F.col(weight).cast("double"), F.col("__all").cast("double"))
    rows = df.join(F.broadcast(weights))  # one row
    return rows.withColumn("amount", F.coalesce(F.col(observed), shared)).withColumn("basis", F.when(F.col(observed).isNull(), "proportional").otherwise("observed")).drop("__all")


def region_totals(df: DataFrame, code: str, sums: dict[str, str], region: str | None = None) -> DataFrame:
    """One row of sums (column: name of its sum), over all rows or those whose code begins with ``region``; a region without rows is an error."""
    rows = df if region is None else df.where(F.startswith(code, F.lit(region)))
    if region is not None and rows.isEmpty():
        raise ValueError(f"no rows of region {region!r}")
    return rows.agg(*[F.sum(c).cast("long").alias(name) for c, name in sums.items()])
