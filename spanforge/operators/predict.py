"""From a model's windows to a video's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.taxonomy import NORMAL
from .islands import coalesce_spans


def absolute(events: DataFrame, duration: bool = True) -> DataFrame:
    """events (t0, t1 in window time, window start w0) in the video's time, with two decimals; duration: cut to the column of that name."""
    at = lambda c: F.col("w0") + F.col(c)
    cut = lambda x: F.least(F.col("duration"), x) if duration else x
    return events.withColumn("t0", F.round(cut(at("t0")), 2)).withColumn("t1", F.round(cut(at("t1")), 2))


def video_events(windows: DataFrame, threshold: float, single_max: float, gap: float = 6.0, normal: str = NORMAL) -> DataFrame:
    """video_id, class_name, t0, t1, confidence of windows (video_id, event_id, class_name, t0, t1, confidence).

    Windows of an event class and enough confidence count. A video that ends by
    `single_max` has one event without times, of the most confident window, the
    first of equals; the windows of others are merged.
    """
    end = F.max("t1").over(Window.partitionBy("video_id"))  # of all windows, not only those that count
    kept = windows.withColumn("_end", end).where((F.col("class_name") != normal) & (F.col("confidence") >= threshold))
    best = F.max_by("class_name", F.struct(F.col("confidence"), -F.col("event_id")))
    none = F.lit(None).cast("double")
    single = kept.where(F.col("_end") <= single_max).groupBy("video_id").agg(best.alias("class_name"), F.max("confidence").alias("confidence"))
    single = single.select("video_id", "class_name", none.alias("t0"), none.alias("t1"), "confidence")
    merged = coalesce_spans(kept.where(F.col("_end") > single_max), ["video_id", "class_name"], gap)
    return single.unionByName(merged.select("video_id", "class_name", "t0", "t1", "confidence"))


def span_policy(events: DataFrame, duration: float, pad: float) -> DataFrame:
    """One span per video and class, from its first event to its last, `pad` wider on both sides and cut to the duration."""
    t = events.groupBy("video_id", "class_name").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.max("confidence").alias("confidence"))
    return t.withColumn("t0", F.greatest(F.lit(0.0), F.col("t0") - pad)).withColumn("t1", F.least(F.lit(duration), F.col("t1") + pad))


def page_of(df: DataFrame, order: list, skip: int, take: int) -> DataFrame:
    """The rows `skip` to `skip + take` of the order."""
    return df.orderBy(*order).offset(skip).limit(take)
