"""What a page shows of a run: pairs of truth and model, verdicts, totals and bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import iou


def states(videos: DataFrame, rows: DataFrame) -> DataFrame:
    """video_id, level, duration, state of each video of the manifest: ok, failed (its row says so) or not_run (no row)."""
    seen = rows.groupBy("video_id").agg(F.max(F.col("failed").isNotNull()).alias("_failed"))
    state = F.when(F.col("_failed").isNull(), "not_run").when(F.col("_failed"), "failed").otherwise("ok")
    return videos.join(seen, "video_id", "left").withColumn("state", state).drop("_failed")


def run_totals(states: DataFrame) -> DataFrame:
    of = lambda s: F.count_if(F.col("state") == s)
    return states.agg(of("ok").alias("videos_predicted"), of("failed").alias("videos_failed"), of("not_run").alias("videos_not_run"), F.count("*").alias("videos_total"))


def truth_shown(truth: DataFrame, matches: DataFrame, states: DataFrame) -> DataFrame:
    """Truth events with verdict (pending where the video was not predicted), iou and pair (the prediction's place)."""
    m = matches.select("video_id", "gi", F.col("pi").alias("pair"), "iou")
    t = truth.drop("duration").join(states.select("video_id", "state", "duration"), "video_id").join(m, ["video_id", "gi"], "left")
    timed = F.col("t0").isNotNull() & F.col("t1").isNotNull()
    verdict = F.when(F.col("state") != "ok", "pending").when(F.col("pair").isNotNull(), "hit").otherwise("miss")
    return t.select("video_id", "gi", "class_name", F.when(timed, F.col("t0")).otherwise(0.0).alias("start"), F.when(timed, F.col("t1")).otherwise(F.col("duration")).alias("end"), timed.alias("localised"), verdict.alias("verdict"), "iou", "pair")


def model_shown(pred: DataFrame, shown: DataFrame, matches: DataFrame, states: DataFrame) -> DataFrame:
    """Predictions with verdict, iou and pair; iou_untimed tells on level 1, where times do not count, what the overlap with the shown truth would be."""
    m = matches.select("video_id", "pi", F.col("gi").alias("pair"), "iou")
    g = shown.select("video_id", F.col("gi").alias("pair"), F.col("start").alias("_g0"), F.col("end").alias("_g1"))
    p = pred.drop("level", "duration").join(states.where("state = 'ok'").select("video_id", "level", "duration"), "video_id").join(m, ["video_id", "pi"], "left").join(g, ["video_id", "pair"], "left")
    timed = F.col("t0").isNotNull() & F.col("t1").isNotNull()
    untimed = F.when(F.col("pair").isNotNull() & (F.col("level") == 1) & timed, F.round(iou("t0", "t1", "_g0", "_g1"), 3))
    verdict = F.when(F.col("pair").isNotNull(), "hit").otherwise("false_alarm")
    return p.select("video_id", "pi", "class_name", F.when(timed, F.col("t0")).otherwise(0.0).alias("start"), F.when(timed, F.col("t1")).otherwise(F.col("duration")).alias("end"), verdict.alias("verdict"), "iou", "pair", untimed.alias("iou_untimed"))


def class_bars(shown: DataFrame, top: int = 8) -> DataFrame:
    """class_name, hit, fa of the classes with most false alarms."""
    t = shown.groupBy("class_name").agg(F.count_if(F.col("verdict") == "hit").alias("hit"), F.count_if(F.col("verdict") != "hit").alias("fa"))
    return t.orderBy(F.desc("fa"), "class_name").limit(top)


def window_grid(windows: DataFrame, empty: DataFrame) -> DataFrame:
    """video_id, w0, w1: the distinct windows that a run was made on, whether they gave events or not, in order of end and start."""
    both = windows.select("video_id", "w0", "w1").unionByName(empty.select("video_id", "w0", "w1"))
    return both.where("w0 IS NOT NULL AND w1 IS NOT NULL").distinct().orderBy("video_id", "w1", "w0")


def first_answer(sources: list[DataFrame], key: str) -> DataFrame:
    """Of each key the rows of the first source that has it, with its place as `source`."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("source", F.lit(i))
        out = s if out is None else out.unionByName(s)
    from pyspark.sql import Window

    return out.withColumn("_k", F.min("source").over(Window.partitionBy(key))).where("source = _k").drop("_k")


def union_runs(runs: list[DataFrame]) -> DataFrame:
    """The rows of all runs with the run's number as `run`."""
    out = runs[0].withColumn("run", F.lit(0))
    for i, r in enumerate(runs[1:], 1):
        out = out.unionByName(r.withColumn("run", F.lit(i)))
    return out
