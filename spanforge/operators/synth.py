"""Planning of composed videos: offsets, labels, pools, gates, repeatable draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import col
from .islands import merge_consecutive


def draw(seed: int, *parts) -> Column:
    """A number from 0 to 1 that depends on the seed and the parts alone, so that any task draws the same."""
    text = F.concat_ws("/", F.lit(str(seed)), *(col(p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def weighted(u: Column, weights: list[float]) -> Column:
    """Which of the weights' shares of 1, from 0, the number u falls in."""
    total, upto, out = sum(weights), 0.0, F.lit(len(weights) - 1)
    bounds = []
    for w in weights:
        upto += w
        bounds.append(upto / total)
    for i in range(len(weights) - 2, -1, -1):
        out = F.when(u < bounds[i], i).otherwise(out)
    return out


def plan(videos: DataFrame, key: str, seed: int, deeper: float = 0.4, empty: float = 0.12, single: float = 0.45, counts=(1, 1, 2, 2, 3, 4, 6)) -> DataFrame:
    """key, level (2, or 3 for a share), n_events (0 for the empty share), one_class: the random part of a composition, drawn by key."""
    d = lambda what: draw(seed, key, F.lit(what))
    n = F.element_at(F.array(*map(F.lit, counts)), (F.floor(d("count") * len(counts)) + 1).cast("int"))
    n = F.when(d("empty") < empty, 0).otherwise(n)
    return videos.select(key, F.when(d("level") < 1 - deeper, 2).otherwise(3).alias("level"), n.alias("n_events"), ((n > 0) & (d("single") < single)).alias("one_class"))


def trim(t0, t1, real, want, u: Column, least: float = 0.5) -> tuple[Column, Column]:
    """(start, length) of `want` seconds inside an event, or the clip where it has no times, at the place u (0 to 1); never beyond the clip's real end."""
    a = F.least(F.greatest(F.lit(0.0), F.coalesce(col(t0), F.lit(0.0))), F.greatest(F.lit(0.0), col(real) - least))
    b = F.least(F.coalesce(col(t1), col(real)), col(real))
    length = F.greatest(F.lit(least), F.least(col(want), b - a))
    start = a + u * F.greatest(F.lit(0.0), b - a - length)
    return start, F.greatest(F.lit(least), F.least(length, col(real) - start))


def segments(event0, event1, lead, tail, jump: float = 0.0) -> Column:
    """Array of (t0, t1) to cut from a clip: an event with its lead-in and tail; jump: without so long a piece in its middle."""
    a, b = F.greatest(F.lit(0.0), col(event0) - lead), col(event1) + tail
    mid = (col(event0) + col(event1)) / 2
    whole = F.array(F.struct(a.alias("t0"), b.alias("t1")))
    if not jump:
        return whole
    halves = F.array(F.struct(a.alias("t0"), (mid - jump / 2).alias("t1")), F.struct((mid + jump / 2).alias("t0"), b.alias("t1")))
    return F.when(col(event1) - col(event0) > 2 * jump, halves).otherwise(whole)


def label_end(duration, label_start, label_length) -> Column:
    """Where a segment's label ends: at its end, unless the label has a length."""
    return F.coalesce(col(label_start) + col(label_length), col(duration))


def offsets(segments: DataFrame, key: str, order: str, duration: str = "duration") -> DataFrame:
    """segments with `offset`, the length of the key's segments before."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("offset", F.coalesce(F.sum(duration).over(w), F.lit(0.0)))


def composed_events(segments: DataFrame, key: str, order: str) -> DataFrame:
    """The events of compositions from labelled segments (duration, label_start, label_length, class_name): an event cut into neighbouring segments is one again."""
    rows = offsets(segments, key, order).withColumn("offset", F.round("offset", 6)).where("class_name IS NOT NULL")
    t1 = F.col("offset") + label_end("duration", "label_start", "label_length")
    rows = rows.select(key, "class_name", (F.col("offset") + F.col("label_start")).alias("t0"), t1.alias("t1"), F.col(order).alias("event_id"))
    return merge_consecutive(rows, [key], "class_name", 0.75, 0.5)


def duration_gate(planned: DataFrame, actual: DataFrame, key: str, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): videos whose actual length is known and within the tolerance of the planned one, and the others."""
    both = planned.join(actual.select(key, F.col("duration").alias("actual")), key, "left")
    ok = F.coalesce(F.abs(F.col("actual") - F.col("duration")) <= tolerance, F.lit(False))
    return both.where(ok), both.where(~ok)


def clip_pool(rows: DataFrame, durations: DataFrame, present: DataFrame, key: str, least: float = 1.0) -> DataFrame:
    """Labelled clip rows with their real duration: those known, at least `least` long, whose file is present."""
    known = durations.where(F.col("duration") >= least).select(key, F.col("duration").alias("real_duration"))
    return rows.where(F.trim("class_name") != "").join(known, key).join(present.select(key), key, "left_semi")
