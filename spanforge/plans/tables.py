"""The driver's tables read as event data: spans, runs, windows, tracks, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Hours in the month that the events cover: the duration of each video.
DURATION = 720.0
CLASSES = ["click", "view", "purchase", "signup", "error"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a span of `value` hours from its time on, of its user's video."""
    hours = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / F.lit(3.6e9)
    df = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("video_id"),
        (1 + F.col("user_id") % 3).cast("int").alias("level"),
        F.col("event_type").alias("class_name"),
        hours.alias("t0"),
        (hours + F.col("value")).alias("t1"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"),
        "value",
    )
    return df


def truth(spark, sf_dir):
    return spans(spark, sf_dir).where("event_id % 2 = 0")


def predictions(spark, sf_dir):
    return spans(spark, sf_dir).where("event_id % 2 = 1")


def videos(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id")).distinct().withColumn("level", (1 + F.col("video_id") % 3).cast("int"))


def hourly(spark, sf_dir):
    """video_id, t (whole hour), x (mean value of the hour), label (an error span covers the hour)."""
    s = spans(spark, sf_dir)
    hours = s.groupBy("video_id", F.floor("t0").cast("long").alias("t")).agg(F.avg("value").alias("x"), F.min("event_id").alias("event_id"))
    errors = s.where("class_name = 'error'").select("video_id", F.col("t0").alias("a"), F.col("t1").alias("b"))
    h, e = hours.alias("h"), errors.alias("e")
    hit = h.join(e, (F.col("h.video_id") == F.col("e.video_id")) & (F.col("h.t") >= F.col("e.a")) & (F.col("h.t") <= F.col("e.b")), "left_semi").select("video_id", "t", F.lit(True).alias("label"))
    return hours.join(hit, ["video_id", "t"], "left").withColumn("label", F.coalesce("label", F.lit(False)))


def tracks(spark, sf_dir):
    """One object per user and class: time in hours, x the value, y the confidence."""
    return spans(spark, sf_dir).select("event_id", "video_id", "class_name", F.col("t0").alias("t"), F.col("value").alias("x"), F.col("confidence").alias("y"))


def sequences(spark, sf_dir):
    """Blocks of 8 consecutive vectors as a sequence of frames."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 8).cast("long").alias("seq"), "vec_id", "embedding", "label")


def ranked(df, keys, order, name):
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
