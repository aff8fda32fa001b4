"""Joins and merges of staged tables: last duplicate wins, tiers of keys, upserts, evolving schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the last in the order."""
    turned = [F.col(c).desc_nulls_last() if isinstance(c, str) else c.desc_nulls_last() for c in order]
    w = Window.partitionBy(*keys).orderBy(*turned)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_kept(rows: DataFrame, key: Column, order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the order; rows whose key is null or blank all stay."""
    keyed = rows.withColumn("__key", F.nullif(key, F.lit("")))
    w = Window.partitionBy("__key").orderBy(*order)
    once = keyed.where(F.col("__key").isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return once.unionByName(keyed.where(F.col("__key").isNull())).drop("__key")


def tiers(*named: tuple[str, Column]) -> tuple[Column, Column]:
    """(value, name of its tier): the first tier that has a value; ``unresolved`` where none has."""
    value = F.coalesce(*[c for _, c in named])
    tag = F.lit("unresolved")
    for name, c in reversed(named):
        tag = F.when(c.isNotNull(), name).otherwise(tag)
    return value, tag


def registry_differences(left: DataFrame, right: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """Full outer comparison: ``key, field, left_value, right_value`` of each field that differs (null-safe)."""
    a = left.select(F.col(key), *[F.col(c).alias(f"a_{c}") for c in compared])
    b = right.select(F.col(key), *[F.col(c).alias(f"b_{c}") for c in compared])
    both = a.join(b, key, "full")
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").cast("long").alias("left_value"), F.col(f"b_{c}").cast("long").alias("right_value")) for c in compared])
    return both.select(key, F.explode(pairs).alias("p")).select(key, "p.*").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def evolved(*generations: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """All generations of a table in one; columns that an older one lacks get the default or null."""
    whole = generations[0]
    for g in generations[1:]:
        whole = whole.unionByName(g, allowMissingColumns=True)
    for name, value in (defaults or {}).items():
        whole = whole.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return whole


def overridden(rows: DataFrame, overrides: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key, columns, basis``: the override's values where there is one, else the row's own.

    ``basis`` is ``override``, ``own``, or ``unmatched`` for an override that fits no row.
    Keys are distinct on both sides; null keys meet nothing.
    """
    a = rows.select(key, F.lit(True).alias("__row"), *[F.col(c).alias(f"__a_{c}") for c in columns])
    b = overrides.select(key, F.lit(True).alias("__over"), *[F.col(c).alias(f"__b_{c}") for c in columns])
    basis = F.when(F.col("__row").isNull(), "unmatched").when(F.col("__over").isNotNull(), "override").otherwise("own")
    return a.join(b, key, "full").select(key, *[F.when(F.col("__over").isNotNull(), F.col(f"__b_{c}")).otherwise(F.col(f"__a_{c}")).alias(c) for c in columns], basis.alias("basis"))
