"""Writers: documents, dataset triples, training rows, caches and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import NORMAL
from ..functions.text import script_safe


def write_submission(predictions: DataFrame, path: str, submission_id: str, model_name: str) -> None:
    """One JSON document per line and video, in the order of `manifest_ord` (range partitioned, so that it need not fit one task)."""
    out = predictions.select("manifest_ord", F.to_json(F.struct(F.lit(submission_id).alias("submission_id"), F.lit(model_name).alias("model_name"), "video_id", "events"), {"ignoreNullFields": "false"}).alias("value"))
    out.orderBy("manifest_ord").select("value").write.mode("overwrite").text(path)


def write_payload(entries: DataFrame, path: str, schema_version: str, submission_id: str, model_name: str, hardware: str = "unspecified", total_wall_time_ms: float = 0.0) -> None:
    """The submission as one JSON document, in one file of the folder, from submission_entries(): a line for the head, one per video in the manifest's order, one for the end.

    One task writes it, line by line, so its size is no matter of memory.
    """
    run = {"total_wall_time_ms": total_wall_time_ms, "max_parallel_videos": 1, "hardware": hardware}
    head = json.dumps({"schema_version": schema_version, "submission_id": submission_id, "model_name": model_name, "run_metadata": run, "predictions": []})
    spark = entries.sparkSession
    ends = spark.createDataFrame([(0, None, head[:-2]), (2, None, "]}")], "part int, manifest_ord long, line string")
    first = entries.agg(F.min("manifest_ord").alias("first"))
    body = entries.join(F.broadcast(first)).select(F.lit(1).alias("part"), F.col("manifest_ord").cast("long").alias("manifest_ord"), F.concat(F.when(F.col("manifest_ord") == F.col("first"), "").otherwise(","), "entry").alias("line"))
    body.unionByName(ends).coalesce(1).sortWithinPartitions("part", "manifest_ord").select("line").write.mode("overwrite").text(path)


def refuse(violations: DataFrame, shown: int = 20) -> None:
    """Raises with the first problems if there are any."""
    found = violations.orderBy("problem", "video_id", "ord").limit(shown).collect()
    if found:
        raise ValueError("; ".join(f"{r['video_id']}: {r['problem']}" for r in found))


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_dataset(events: DataFrame, videos: DataFrame, folder: str) -> None:
    """ground_truth (times with three decimals, a normal row for a video without events), videos and manifest."""
    time = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.3f", F.col(c)))
    rows = videos.join(events, "video_id", "left").select("video_id", "level", F.coalesce("class_name", F.lit(NORMAL)).alias("class_name"), time("t0").alias("start_time_sec"), time("t1").alias("end_time_sec"))
    rows.write.mode("overwrite").option("header", True).csv(f"{folder}/ground_truth")
    videos.select("video_id", F.concat("video_id", F.lit(".mp4")).alias("filename")).write.mode("overwrite").option("header", True).csv(f"{folder}/videos")
    videos.select("video_id", "level", F.col("duration").alias("duration_sec")).write.mode("overwrite").json(f"{folder}/manifest")


def write_training_rows(rows: DataFrame, folder: str, share: float = 0.1, seed: int = 7) -> DataFrame:
    """JSON lines split by a hash of the id into train and val; returns split, rows, negatives."""
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10_000)) < int(10_000 * share)
    rows = rows.withColumn("split", F.when(part, "val").otherwise("train"))
    rows.write.mode("overwrite").partitionBy("split").json(folder)
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.count_if(F.size("events") == 0).alias("negatives"))


def cache_missing(items: DataFrame, path: str, key: str, make) -> DataFrame:
    """Appends make(items not yet cached) to the cache at path and returns the whole cache."""
    spark = items.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:  # no cache yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = items.select(key).limit(0)
    make(items.join(done, key, "left_anti")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def report_lines(levels: DataFrame, classes: DataFrame) -> DataFrame:
    """The score as fixed-width text: ord, line. One row per level and class."""
    a = levels.select(F.col("level").cast("string").alias("o"), F.format_string("D%-5d%7.0f%7.2f%7.2f%7.2f%7d%5d%6d", "level", "marks", "precision", "recall", "f1", "tp", "fa", "miss").alias("line"))
    b = classes.select(F.concat(F.lit("c"), "class_name").alias("o"), F.format_string("%-34s%7d%5d%6d", "class_name", "tp", "fa", "miss").alias("line"))
    return a.unionByName(b).orderBy("o")


def page(rows: DataFrame, template: str) -> str:
    """A page with the rows' JSON in place of {data}; for summaries of bounded size."""
    data = rows.agg(script_safe(F.to_json(F.collect_list(F.struct("*")))).alias("j")).first()["j"]
    return template.replace("{data}", data)
