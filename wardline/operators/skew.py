"""Equi-joins whose crowded keys are dealt to several tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one side under one key beyond which the key is split.
CROWD = 2000


def split_join(left: DataFrame, right: DataFrame, on: Sequence[str], crowd: int = CROWD) -> DataFrame:
    """Inner join on ``on``; a key with more than ``crowd`` rows on either side is split on both.

    Rows of such a key are dealt by their hash to as many parts as their side needs, and
    each part of the left meets each part of the right in a bucket of its own: every
    pair meets once, and no bucket holds more than about ``crowd`` rows of a side.
    Counts of the keys, which are combined before they are shuffled, decide. Rows with a
    null key meet nothing. Rows that are equal in all columns share a part: drop
    repeats beforehand.
    """
    on = list(on)
    counts = left.groupBy(*on).agg(F.count("*").alias("__l")).join(right.groupBy(*on).agg(F.count("*").alias("__r")), on)
    parts = lambda n: F.ceil(F.col(n) / crowd).cast("int")
    crowded = counts.where((F.col("__l") > crowd) | (F.col("__r") > crowd)).select(*on, parts("__l").alias("__l"), parts("__r").alias("__r"))
    l, r = F.coalesce("__l", F.lit(1)), F.coalesce("__r", F.lit(1))
    dealt = lambda n, columns: F.pmod(F.xxhash64(*columns), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a = left.join(crowded, on, "left").withColumn("__i", dealt(l, left.columns)).withColumn("__j", every(r)).drop("__l", "__r")
    b = right.join(crowded, on, "left").withColumn("__j", dealt(r, right.columns)).withColumn("__i", every(l)).drop("__l", "__r")
    return a.join(b, [*on, "__i", "__j"]).drop("__i", "__j")
