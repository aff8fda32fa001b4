"""Session helpers: lineage cuts that survive lost executors, and time columns."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at ``spark.checkpoint.dir``.

    The cluster names a shared folder there; that it doesn't is an error, since a
    folder of one machine would be lost with it. Only on a local master, as in tests,
    is a folder of our own made.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-wardline-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Deletes what ``cut`` wrote for ``df``, once a later round has replaced it and nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    plan = df._jdf.queryExecution().analyzed()
    written = plan.rdd().getCheckpointFile() if plan.nodeName() == "LogicalRDD" else None
    if written is not None and written.isDefined():
        path = jvm.org.apache.hadoop.fs.Path(written.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def utc_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch of a timestamp column.

    A ``timestamp_ntz`` column is read as UTC whatever the session zone is; a text
    column is parsed as ISO 8601 with zone, unparsable text gives null.
    """
    c, kind = df[name], df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        days = F.unix_date(c.cast("date")).cast("long")
        seconds = F.hour(c).cast("long") * 3600 + F.minute(c) * 60 + F.second(c)
        micros = (F.date_part(F.lit("SECOND"), c) * 1000000).cast("long") % 1000000
        return (days * 86400 + seconds) * 1000000 + micros
    if isinstance(kind, T.StringType):
        return F.unix_micros(c.try_cast("timestamp"))
    return F.unix_micros(c.cast("timestamp"))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application, so that
    tasks can import it wherever the driver was started from."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-wardline-")) / "wardline.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
