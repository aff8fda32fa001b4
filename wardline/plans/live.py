"""Queries over the event log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardline.streaming.live import drained, state_changes, table_stream, windowed


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    return drained(windowed(table_stream(spark, d, "events"), "ts", "event_type"))


def stream_state_changes(spark: SparkSession, d: str) -> DataFrame:
    return drained(state_changes(table_stream(spark, d, "events"), "user_id", "ts", "event_id", "event_type"))


QUERIES = {f.__name__: f for f in (stream_windows, stream_state_changes)}
ORACLES = {
    "stream_windows": """select time_bucket(interval '1 hour', ts) window_start, event_type, count(*) n from events where time_bucket(interval '1 hour', ts) + interval '1 hour' <= (select max(ts) from events) - interval '1 hour' group by 1, 2""",
    "stream_state_changes": """select user_id unit, event_id "event", event_type state from (select *, row_number() over w n, lag(event_type) over w p from events window w as (partition by user_id order by ts, event_id)) where n = 1 or event_type is distinct from p""",
}
