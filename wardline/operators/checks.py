"""Rules on tables, reported as rows of violations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    broken: Column


def violations(rows: DataFrame, table: str, key: str, rules: Sequence[Rule]) -> DataFrame:
    """``table_name, rule, record_key`` of every broken rule; a condition that is null is not broken. One pass."""
    hits = F.array_compact(F.array(*[F.when(r.broken, F.lit(r.name)) for r in rules]))
    return rows.select(F.lit(table).alias("table_name"), F.explode(hits).alias("rule"), F.col(key).cast("string").alias("record_key"))


def duplicates(rows: DataFrame, table: str, key: str) -> DataFrame:
    """Keys of more than one distinct row, as violations of ``duplicate_key``."""
    return rows.distinct().groupBy(key).count().where(F.col("count") > 1).select(F.lit(table).alias("table_name"), F.lit("duplicate_key").alias("rule"), F.col(key).cast("string").alias("record_key"))


def require_none(found: DataFrame, what: str) -> None:
    """Raises ValueError with a few examples if there are violations."""
    examples = found.limit(5).collect()
    if examples:
        raise ValueError(f"{what}: {[r.asDict() for r in examples]}")
