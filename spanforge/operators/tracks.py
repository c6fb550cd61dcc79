"""Events derived from tracked objects: still vehicles, lingering people, congestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import col
from .islands import coalesce_spans, sustained_runs
from .signals import velocity

#: Ids of the detector's classes, fixed values.
VEHICLES = {1: "bicycle", 2: "car", 3: "motorcycle", 5: "bus", 7: "truck"}
PERSON = 0


def box_centre(x0, y0, x1, y1) -> tuple[Column, Column]:
    return (col(x0) + col(x1)) / 2, (col(y0) + col(y1)) / 2


def every_nth(df: DataFrame, keys: list[str], order: list, fps: Column, wanted: float) -> DataFrame:
    """Rows (frames) whose place from 0 among the key's is a multiple of the stride, max(1, round(fps / wanted))."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("_place", place).where(F.col("_place") % F.greatest(F.lit(1), F.bround(fps / wanted, 0).cast("int")) == 0).drop("_place")


def lasting(t0, t1) -> Column:
    """Confidence that grows with a span's length, from 0.4 to 0.9; what lies behind nine decimals is noise of the division and decides no tie."""
    return F.round(F.round(F.least(F.lit(0.9), 0.4 + (col(t1) - col(t0)) / 60), 9), 2)


def compensated(points: DataFrame, diagonal: Column, moment: Callable[[Column], Column]) -> DataFrame:
    """video_id, track_id, cls_id, event_id, t, moment, speed: each track's speed beside the median motion of all tracks at that moment, in diagonals."""
    v = velocity(points, ["video_id", "track_id"], "t", "x", "y", ["t", "event_id"]).withColumn("moment", moment(F.col("t")))
    ego = v.groupBy("video_id", "moment").agg(F.median("vx").alias("ex"), F.median("vy").alias("ey"))
    v = v.join(ego, ["video_id", "moment"])
    speed = F.sqrt(F.pow(F.col("vx") - F.col("ex"), 2) + F.pow(F.col("vy") - F.col("ey"), 2)) / diagonal
    return v.select("video_id", "track_id", "cls_id", "event_id", "t", "moment", speed.alias("speed"))


def congestion(samples: DataFrame, keys: list[str], t: str, speed: str, vehicles: int = 8, share: float = 0.45, least: float = 6.0, counts: DataFrame | None = None) -> DataFrame:
    """keys, t0, t1, n, peak: runs of at least `least` with many objects whose median speed is under `share` of the usual one of the keys.

    samples: one row per object and time. counts: keys, t, vehicles where others than the samples are counted.
    """
    h = samples.groupBy(*keys, t).agg(F.count("*").alias("vehicles"), F.median(speed).alias("_speed"))
    if counts is not None:
        h = counts.join(h.drop("vehicles"), [*keys, t], "left")
    h = h.withColumn("_speed", F.coalesce("_speed", F.lit(0.0)))
    usual = h.groupBy(*keys).agg(F.coalesce(F.median(F.when(F.col("_speed") > 0, F.col("_speed"))), F.lit(1e-6)).alias("_usual"))
    k = h.join(usual, keys)
    runs = sustained_runs(k, keys, t, (F.col("vehicles") >= vehicles) & (F.col("_speed") < share * F.col("_usual")), least)
    inside = [F.col(f"r.{c}") == F.col(f"k.{c}") for c in keys] + [F.col(f"k.{t}") >= F.col("r.t0"), F.col(f"k.{t}") <= F.col("r.t1")]
    return runs.alias("r").join(k.alias("k"), inside).groupBy(*(f"r.{c}" for c in keys), "r.t0", "r.t1", "r.n").agg(F.max("k.vehicles").alias("peak"))


def merge_same_class(events: DataFrame, gap: float = 2.0) -> DataFrame:
    """Events of a video and class within `gap` become one, with the first one's explanation."""
    first = F.min_by("explanation", F.struct("t0", "event_id"))
    return coalesce_spans(events, ["video_id", "class_name"], gap, extra={"explanation": first}).drop("n")


def derive_events(
    points: DataFrame,
    diagonal: Column,
    stalled: float = 8.0,
    loiter: float = 12.0,
    jam: float = 6.0,
    still: float = 0.004,
    vehicles: int = 8,
    samples: int = 3,
    moment: Callable[[Column], Column] = lambda t: F.round(t, 2),
) -> DataFrame:
    """video_id, class_name, t0, t1, confidence, explanation, in order of start, from points (video_id, track_id, cls_id, event_id, t, x, y).

    A vehicle that is still for `stalled`, a person for `loiter`, and congestion
    for `jam`; tracks with fewer than `samples` speeds make no event of their own.
    """
    speeds = compensated(points, diagonal, moment)
    is_vehicle = F.col("cls_id").isin(*VEHICLES)
    enough = speeds.groupBy("video_id", "track_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= samples).drop("_n")
    own = speeds.join(enough, ["video_id", "track_id"])
    name = F.element_at(F.create_map(*[F.lit(x) for kv in VEHICLES.items() for x in kv]), F.col("cls_id"))
    keys = ["video_id", "track_id", "cls_id"]
    length = F.format_string("%.0f", (F.col("t1") - F.col("t0")).cast("double"))

    def events(rows, least, class_name, explanation):
        runs = sustained_runs(rows, keys, "t", F.col("speed") < still, least, ["t", "event_id"])
        return runs.select("video_id", F.lit(class_name).alias("class_name"), F.round("t0", 2).alias("t0"), F.round("t1", 2).alias("t1"), lasting("t0", "t1").alias("confidence"), explanation.alias("explanation"))

    # fixed texts
    a = events(own.where(is_vehicle), stalled, "stalled_or_broken_down_vehicle", F.concat(F.lit("A "), name, F.lit(" remains stationary for "), length, F.lit(" seconds while other traffic continues around it.")))
    b = events(own.where(F.col("cls_id") == PERSON), loiter, "loitering_or_suspicious_presence", F.concat(F.lit("A person stays in the same location for "), length, F.lit(" seconds without moving on.")))
    counts = points.where(is_vehicle).withColumn("moment", moment(F.col("t"))).groupBy("video_id", "moment").agg(F.count("*").alias("vehicles"))
    c = congestion(speeds.where(is_vehicle), ["video_id"], "moment", "speed", vehicles, least=jam, counts=counts)
    text = F.concat(F.lit("Vehicle density rises to "), F.col("peak").cast("string"), F.lit(" while median speed falls to under half the scene baseline, sustained for "), length, F.lit(" seconds."))
    c = c.select("video_id", F.lit("traffic_congestion").alias("class_name"), F.round(F.col("t0").cast("double"), 2).alias("t0"), F.round(F.col("t1").cast("double"), 2).alias("t1"), F.lit(0.6).alias("confidence"), text.alias("explanation"))
    every = a.unionByName(b).unionByName(c)
    # ties of the start are told apart by the text
    return merge_same_class(every.withColumn("event_id", F.struct("t1", "explanation"))).orderBy("video_id", "t0", "class_name")
