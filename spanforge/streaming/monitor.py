"""Structured Streaming: the alert feed and windowed latency, with watermarks; beyond what a batch replay does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def alerts(events: DataFrame, mean_ms) -> DataFrame:
    """Events with the time that they become known: their end (or their window's) and the mean latency after it."""
    return events.withColumn("alert_at", F.coalesce("window_end", "t1") + F.lit(mean_ms) / 1000)


def due(events: DataFrame, clock: float) -> DataFrame:
    """What a replay shows at a clock; going back hides what is not due yet."""
    return events.where(F.col("alert_at") <= clock)


def windowed_latency(stream: DataFrame, at: str, key: str, ms: str, window: str = "20 seconds", slide: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Calls, mean and greatest latency by key and sliding window; events later than `late` are dropped."""
    rows = stream.withWatermark(at, late).groupBy(F.window(at, window, slide), key)
    out = rows.agg(F.count("*").alias("calls"), F.avg(ms).alias("mean_ms"), F.max(ms).alias("max_ms"))
    return out.select(F.col("window.start").alias("w0"), F.col("window.end").alias("w1"), key, "calls", "mean_ms", "max_ms")


def sessions(stream: DataFrame, at: str, key: str, gap: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """Runs of rows of a key not more than `gap` apart: the streaming form of spike groups."""
    rows = stream.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("session_window.start").alias("at"), "n")


def deduplicated(stream: DataFrame, at: str, keys: list[str], late: str = "1 minute") -> DataFrame:
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def append_to(stream: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Appends each micro-batch to a Parquet table; exactly once through the checkpoint. Without a trigger it runs until what is there is read."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()
