"""Window planning, clipping of events to windows and as-of look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import col, overlap


def plan_windows(duration, win: float = 20.0, hop: float = 10.0, single_max: float = 30.0) -> Column:
    """Array of windows (t0, t1): one for a short duration, else each hop until one reaches the end; the last is cut."""
    d = col(duration).cast("double")
    n = F.when(d <= single_max, 1).otherwise(F.least(F.ceil(d / hop), F.greatest(F.lit(1), F.ceil((d - win) / hop) + 1)))
    one = F.array(F.struct(F.lit(0.0).alias("t0"), d.alias("t1")))
    many = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: F.struct((k * F.lit(hop)).alias("t0"), F.least(k * F.lit(hop) + win, d).alias("t1")))
    return F.when(d <= single_max, one).otherwise(many)


def clip_to_windows(windows: DataFrame, events: DataFrame, least: float = 0.5) -> DataFrame:
    """Windows (video_id, w0, w1) left joined to the events they hold `least` of, in window time; a window without one stays."""
    w, e = windows.alias("w"), events.alias("e")
    shared = overlap("w.w0", "w.w1", "e.t0", "e.t1")
    on = (F.col("w.video_id") == F.col("e.video_id")) & (F.col("e.t0") < F.col("w.w1")) & (F.col("w.w0") < F.col("e.t1")) & (shared >= least)
    out = w.join(e, on, "left")
    r0 = F.greatest(F.col("e.t0"), F.col("w.w0")) - F.col("w.w0")
    r1 = F.least(F.col("e.t1"), F.col("w.w1")) - F.col("w.w0")
    known = F.col("e.video_id").isNotNull()
    return out.select("w.video_id", "w.w0", "w.w1", "e.class_name", F.when(known, r0).alias("r0"), F.when(known, r1).alias("r1"))


def as_of(points: DataFrame, marks: DataFrame, key: str, at: str, mark: str, forward: bool = False, nearest: bool = False) -> DataFrame:
    """points with the last mark at or before their time (forward: the first at or after it), in one sort by (key, time).

    Without one it is NULL; nearest: then the key's first mark (forward: its last one).
    """
    p = points.select("*", F.col(at).alias("_t"), F.lit(None).cast(marks.schema[mark].dataType).alias("_m"), F.lit(1).alias("_point"))
    m = marks.select(key, F.col(mark).alias("_t"), F.col(mark).alias("_m"), F.lit(0).alias("_point"))
    both = p.unionByName(m, allowMissingColumns=True)
    if forward:
        w = Window.partitionBy(key).orderBy(F.desc("_t"), "_point").rowsBetween(Window.unboundedPreceding, 0)
    else:
        w = Window.partitionBy(key).orderBy("_t", "_point").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("_m", ignorenulls=True).over(w)
    if nearest:
        found = F.coalesce(found, (F.max if forward else F.min)("_m").over(Window.partitionBy(key)))
    return both.withColumn(mark, found).where("_point = 1").drop("_t", "_m", "_point")
