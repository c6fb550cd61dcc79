"""The closed vocabulary of event classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed values, in the order that ties follow.
CLASSES = [
    "traffic_accident",
    "traffic_congestion",
    "stalled_or_broken_down_vehicle",
    "vehicle_blocking_traffic",
    "wrong_way_driving",
    "road_spill_or_debris",
    "fire",
    "smoke",
    "waterlogging_or_flood",
    "fighting_or_violence",
    "loitering_or_suspicious_presence",
]
#: What a video without events is labelled with.
NORMAL = "normal"


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CLASSES)), "class_ord int, class_name string")


def drift(a: list[str], b: list[str]) -> list[str]:
    """What one vocabulary has and the other lacks, either way."""
    return sorted({*a} ^ {*b})
