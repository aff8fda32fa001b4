from pyspark.sql import functions as F

from wardline.streaming.live import drained, state_changes, table_stream, windowed


def test_late_rows_and_states_across_batches(spark, tmp_path):
    folder = tmp_path / "log.parquet"

    def write(name, rows):
        spark.createDataFrame(rows, "user_id long, ts string, event_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(folder))

    write("a", [(1, "2024-01-01 00:10:00", 1, "idle"), (1, "2024-01-01 05:00:00", 2, "busy")])
    write("b", [(1, "2024-01-01 06:00:00", 3, "busy"), (2, "2024-01-01 00:20:00", 4, "idle"), (1, "2024-01-01 09:00:00", 5, "idle")])
    got = drained(state_changes(table_stream(spark, str(tmp_path), "log"), "user_id", "ts", "event_id", "event_type"))
    assert {(r.unit, r.event) for r in got.collect()} == {(1, 1), (1, 2), (1, 5), (2, 4)}
    windows = drained(windowed(table_stream(spark, str(tmp_path), "log"), "ts", "event_type"))
    assert {(str(r.window_start), r.event_type, r.n) for r in windows.collect()} == {("2024-01-01 00:00:00", "idle", 2), ("2024-01-01 05:00:00", "busy", 1), ("2024-01-01 06:00:00", "busy", 1)}
