"""Writing tables and documents, and collecting what is still missing from an outside service."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.session import cut


def write_csv(df: DataFrame, path: str, fields: Sequence[str], files: int | None = None) -> None:
    """The fields in fixed order, others left out; nested ones as JSON text. Replaces the folder at once."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    flat = df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in fields])
    (flat.coalesce(files) if files else flat).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def documents(df: DataFrame, key: str) -> DataFrame:
    """``key, document``: each row as a JSON document."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("document"))


def first_success(attempts: Column, result: Callable[[Column], Column]) -> Column:
    """The first non-null result over an array of attempts in order."""
    return F.get(F.filter(F.transform(attempts, result), lambda r: r.isNotNull()), F.lit(0))


def collect_missing(required: DataFrame, measured: DataFrame, keys: Sequence[str], call: Callable[[pd.DataFrame], pd.DataFrame], schema: str, budget: int | None = None) -> DataFrame:
    """Answers of ``call`` for the required keys that are not measured yet, in key order, at most ``budget`` of them.

    ``call`` gets blocks of keys and returns rows of ``schema``; errors belong into a
    column of it, so that rejected keys are rows too and can be written apart.
    """
    todo = required.select(*keys).distinct().join(measured.select(*keys), list(keys), "left_anti")
    if budget is not None:
        todo = todo.orderBy(*keys).limit(budget)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield call(frame)

    return todo.mapInPandas(run, schema)


def split_rejects(df: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without a problem, the others with it as ``problem``)."""
    told = df.withColumn("problem", problem)
    return told.where(F.col("problem").isNull()).drop("problem"), told.where(F.col("problem").isNotNull())


def append_rejects(rejects: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Appends rejected rows to a table of dead letters; those whose keys it already holds are left out."""
    spark = rejects.sparkSession
    try:
        known = spark.read.parquet(path)
    except AnalysisException:  # the first run
        known = None
    fresh = rejects if known is None else rejects.join(known.select(*keys).distinct(), list(keys), "left_anti")
    cut(fresh.dropDuplicates(list(keys))).write.mode("append").parquet(path)


def write_checked(df: DataFrame, path: str) -> DataFrame:
    """Writes a table, reads it again and raises unless rows and content are the same; gives what was read."""
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    mark = lambda rows: rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    if mark(df) != mark(back):
        raise ValueError(f"{path}: what was written differs from what is read")
    return back
