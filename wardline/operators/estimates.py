"""Means with confidence intervals and paired differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.numbers import rounded

Z = 1.96


def estimate(value: Column) -> list[Column]:
    """n, mean, sample deviation and 95 % interval; the last three null for fewer than two values."""
    n, sd = F.count(value), F.stddev_samp(value)
    half = F.lit(Z) * sd / F.sqrt(n.cast("double"))
    return [
        n.alias("n"),
        rounded(F.avg(value)).alias("mean"),
        rounded(F.when(n >= 2, sd)).alias("sd"),
        rounded(F.when(n >= 2, F.avg(value) - half)).alias("low"),
        rounded(F.when(n >= 2, F.avg(value) + half)).alias("high"),
    ]


def paired(values: DataFrame, pair: str, variant: str, value: str, baseline: str) -> DataFrame:
    """Estimates of each variant minus the baseline over the pairs both have."""
    base = values.where(F.col(variant) == baseline).select(pair, F.col(value).alias("base"))
    return values.where(F.col(variant) != baseline).join(base, pair).groupBy(variant).agg(*estimate(F.col(value) - F.col("base")))
