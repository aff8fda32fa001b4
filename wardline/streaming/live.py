"""Operation logs as streams: windowed counts with late data, and changes of state per unit."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardline.session import ensure_checkpoint_dir


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """The files of a table (one file, or a folder of files) as a stream."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path[:-1] + "[t]")  # a pattern also takes a single file


def windowed(stream: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per window and kind; a window is final, and late events are left out, once the watermark passes its end."""
    w = F.window("__at", width)
    timed = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return timed.groupBy(w.alias("w"), F.col(kind)).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col(kind), "n")


def state_changes(stream: DataFrame, unit: str, at: str, event: str, state: str) -> DataFrame:
    """``unit, event, state`` of events at which a unit's state differs from the last one known.

    The last state of each unit is kept from batch to batch; within a batch events are
    ordered by time and event id, events of later batches count as later. So the result
    of a log whose files are out of order depends on how many files a batch takes. A
    unit's events of one batch are sorted in one task's memory: ``files_per_trigger``
    bounds them, however many a unit has in all.
    """

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        known = kept.exists
        last = kept.get[0] if known else None
        rows = pd.concat(list(frames)).sort_values(["at", "event"])
        out = []
        for event_id, now in zip(rows.event, rows.state):
            if not known or now != last:
                out.append((key[0], event_id, now))
            known, last = True, now
        kept.update((last,))
        yield pd.DataFrame(out, columns=["unit", "event", "state"])

    named = stream.select(F.col(unit).cast("long").alias("unit"), F.col(at).alias("at"), F.col(event).cast("long").alias("event"), F.col(state).alias("state"))
    return named.groupBy("unit").applyInPandasWithState(run, "unit long, event long, state string", "state string", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame) -> DataFrame:
    """Runs the stream over all that is there and gives what it wrote, from the shared checkpoint folder."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4()}"
    query = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")
