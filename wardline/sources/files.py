"""Reading delivered files: CSV in mixed encodings, id-keyed JSON, manifests, folders of partitions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, needed: Sequence[str], what: str) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
    return df


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType | None = None, needed: Sequence[str] = ()) -> DataFrame:
    """CSV in UTF-8, with or without byte order mark, every cell text unless a schema is given; ``source_file`` tells where a row came from."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).csv(paths)
    return require_columns(df, needed, str(paths)).withColumn("source_file", F.col("_metadata.file_path"))


def read_text_lines(spark: SparkSession, paths: str | list[str], encodings: Sequence[str] = ("utf-8-sig", "cp949")) -> DataFrame:
    """``source_file, line_no, line`` of files that are each in one of the encodings, the first that fits.

    For files of moderate size: one file is decoded by one task. A file that fits none
    raises its decoding error.
    """

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame.path, frame.content):
                for i, name in enumerate(encodings):
                    try:
                        text = bytes(content).decode(name)
                        break
                    except UnicodeDecodeError:
                        if i == len(encodings) - 1:
                            raise
                lines = text.splitlines()
                yield pd.DataFrame({"source_file": path, "line_no": range(1, len(lines) + 1), "line": lines})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(decode, "source_file string, line_no long, line string")


def keyed_records(documents: DataFrame, field: str, record: T.StructType, key: str = "id") -> DataFrame:
    """``ordinal, id`` and the record's fields from a JSON field that is an object by id or an array of records.

    ``documents`` has the JSON text in ``value``. The id is the record's own, else its
    name, else the key of the object. Records keep their order as ``ordinal``.
    """
    raw = F.get_json_object("value", f"$.{field}")
    names = {f.name for f in record.fields}
    as_map = F.from_json(raw, T.MapType(T.StringType(), record))
    as_list = F.from_json(raw, T.ArrayType(record))
    entries = F.when(F.startswith(F.ltrim(raw), F.lit("{")), F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))).otherwise(
        F.transform(as_list, lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value")))
    )
    rows = documents.select(F.posexplode(entries).alias("ordinal", "entry"))
    own = [F.col(f"entry.value.{c}") for c in (key, "name") if c in names]
    rest = [F.col(f"entry.value.{f.name}") for f in record.fields if f.name != key]
    return rows.select("ordinal", F.coalesce(*own, F.col("entry.key")).alias(key), *rest)


def verify_manifest(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """``path, problem`` of manifest rows (``path, bytes, sha256``) whose file is missing or differs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.col("path").alias("full"), F.col("length").alias("has_bytes"), F.sha2("content", 256).alias("has_sha256"))
    met = manifest.join(files, F.endswith(F.col("full"), F.concat(F.lit("/"), F.col("path"))), "left")
    problem = F.when(F.col("full").isNull(), "missing").when(F.col("has_bytes") != F.col("bytes"), "size").when(F.col("has_sha256") != F.lower("sha256"), "digest")
    return met.select("path", problem.alias("problem")).where("problem is not null")
