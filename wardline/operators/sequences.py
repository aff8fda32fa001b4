"""Sequences of rows per entity, worked off in pieces.

An entity may own a third of all rows, so no window spans one. Rows are laid out in
ranges of (entity, order); each range is a piece that one task sorts, and what a piece
needs of those before it, a total or the last row, is carried over in one row per
entity and piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import cut

#: Spark's own number of shuffle partitions is the number of pieces, unless told otherwise.
PIECES = 0


def in_pieces(rows: DataFrame, entity: str, order: Sequence[Column | str], pieces: int = PIECES) -> DataFrame:
    """``rows`` with ``__piece``: rows of an entity in a smaller piece come earlier in ``order``, equal ones share a piece.

    The layout is written out, so that a task that is repeated finds the same pieces.
    Entities that are null form one of their own.
    """
    n = pieces or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in (entity, *order)]
    return cut(rows.repartitionByRange(n, *at).withColumn("__piece", F.spark_partition_id()))


def _per_piece(pieced: DataFrame, entity: str, *aggregates: Column) -> tuple[DataFrame, Window]:
    """One row per entity and piece, and the window over the pieces before each."""
    return pieced.groupBy(entity, "__piece").agg(*aggregates), Window.partitionBy(entity).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)


def _with_carried(pieced: DataFrame, carried: DataFrame, entity: str) -> DataFrame:
    same = pieced[entity].eqNullSafe(carried[entity]) & (pieced["__piece"] == carried["__piece"])
    return pieced.join(carried, same, "left").drop(carried[entity]).drop(carried["__piece"])


def running(pieced: DataFrame, entity: str, order: Sequence[Column | str], sums: dict[str, Column]) -> DataFrame:
    """``pieced`` with running sums up to and including each row; nulls add nothing."""
    totals, before = _per_piece(pieced, entity, *[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    carried = totals.select(entity, "__piece", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in sums])
    within = Window.partitionBy(entity, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = pieced.withColumns({f"__i_{n}": F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})
    return _with_carried(inside, carried, entity).withColumns({n: F.col(f"__i_{n}") + F.col(f"__c_{n}") for n in sums}).drop(*[f"__{x}_{n}" for x in "ic" for n in sums])


def with_previous(pieced: DataFrame, entity: str, order: Sequence[str], state: Sequence[str]) -> DataFrame:
    """``pieced`` with ``__before``: the state (a struct) of the entity's row before, null for its first row."""
    now, at = F.struct(*state), F.struct(*order)
    last, before = _per_piece(pieced, entity, F.max_by(now, at).alias("__last"))
    carried = last.select(entity, "__piece", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    w = Window.partitionBy(entity, "__piece").orderBy(*order)
    inside = pieced.withColumn("__lag", F.lag(now).over(w))
    return _with_carried(inside, carried, entity).withColumn("__before", F.coalesce("__lag", "__carried")).drop("__lag", "__carried")


def changes(rows: DataFrame, entity: str, order: Sequence[str], state: Sequence[str]) -> DataFrame:
    """The rows of each entity whose state differs from that of the row before; the first always."""
    told = with_previous(in_pieces(rows, entity, order), entity, order, state)
    return told.where(F.col("__before").isNull() | ~F.struct(*state).eqNullSafe(F.col("__before"))).drop("__before", "__piece")
