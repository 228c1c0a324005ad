"""Structured Streaming over events(event_id, ts, user_id, event_type, value): additions of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows; works on streams and tables alike."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = (events.withWatermark("ts", late) if events.isStreaming else events).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = F.session_window("ts", gap)
    out = (events.withWatermark("ts", late) if events.isStreaming else events).groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_events(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def upsert_stream(stream: DataFrame, path: str, merge, checkpoint: str):
    """Each batch is merged by `merge(store, batch)` into a new folder of versions under `path`; the last one counts."""
    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v={number - 1}") if number else batch.limit(0)
        merge(old, batch).write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
