"""Truth against predictions: candidate pairs, one-to-one assignment, tallies and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import Credit, f1, iou, overlap, precision, recall, within
from .islands import number_runs

#: Marks of the levels, fixed values.
MARKS = {1: 25.0, 2: 35.0, 3: 40.0}


def indexed(events: DataFrame, name: str, keys=("video_id",), order=("class_name", "t0", "event_id")) -> DataFrame:
    """Events with their place among the video's as `name`."""
    return events.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def sides(truth: DataFrame, pred: DataFrame, gap: float | None = 0.0) -> DataFrame:
    """Truth joined to predictions of the same video, class and island, as g0, g1, p0, p1.

    An island is a maximal run of spans of either side within `gap` of each
    other, so pairs that overlap, or that start within the gap, share one; the
    join's work is the product within islands, not within videos. gap None makes
    one island of each video and class.
    """
    both = truth.select("video_id", "class_name", "t0", "t1", F.col("gi").alias("_g"), F.lit(None).cast("int").alias("_p"))
    both = both.unionByName(pred.select("video_id", "class_name", "t0", "t1", F.lit(None).cast("int").alias("_g"), F.col("pi").alias("_p")))
    reach = F.max("t1").over(Window.partitionBy("video_id", "class_name").orderBy("t0").rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("island", F.lit(0).cast("long")) if gap is None else number_runs(both, ["video_id", "class_name"], ["t0"], F.col("t0") > reach + gap, "island")
    g = both.where("_g IS NOT NULL").select("video_id", "class_name", "island", F.col("_g").alias("gi"), F.col("t0").alias("g0"), F.col("t1").alias("g1"))
    p = both.where("_p IS NOT NULL").select("video_id", "class_name", "island", F.col("_p").alias("pi"), F.col("t0").alias("p0"), F.col("t1").alias("p1"))
    return g.join(p, ["video_id", "class_name", "island"])


def candidates(truth: DataFrame, pred: DataFrame, threshold: float = 0.5, tolerance: float | None = None, temporal: bool = True) -> DataFrame:
    """Pairs that may be matched, with their iou; class alone decides where times don't count."""
    if not temporal:
        g, p = truth.select("video_id", "class_name", "gi"), pred.select("video_id", "class_name", "pi")
        return g.join(p, ["video_id", "class_name"]).select("video_id", "class_name", "gi", "pi", F.lit(1.0).alias("iou"))
    both = sides(truth, pred, tolerance if tolerance is not None else 0.0 if threshold > 0 else None)
    score = iou("g0", "g1", "p0", "p1")
    ok = within("g0", "g1", "p0", "p1", tolerance) if tolerance is not None else score >= threshold
    if tolerance is None and threshold > 0:
        both = both.where((F.col("g0") < F.col("p1")) & (F.col("p0") < F.col("g1")))
    return both.where(ok).select("video_id", "class_name", "island", "gi", "pi", score.alias("iou"))


def by_class(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """The matches where class alone counts: the first of a video and class with the first, and so on, which is what the greedy order gives for equal scores."""
    nth = lambda i: F.row_number().over(Window.partitionBy("video_id", "class_name").orderBy(i)).alias("_k")
    g, p = truth.select("video_id", "class_name", "gi", nth("gi")), pred.select("video_id", "class_name", "pi", nth("pi"))
    return g.join(p, ["video_id", "class_name", "_k"]).select("video_id", "class_name", F.col("gi").cast("int").alias("gi"), F.col("pi").cast("int").alias("pi"), F.lit(1.0).alias("iou"))


def match_by_level(truth: DataFrame, pred: DataFrame, videos: DataFrame, threshold: float = 0.5, tolerance: float | None = None) -> DataFrame:
    """video_id, class_name, gi, pi, iou of the matches under the policy of each video's level.

    On level 1 class alone decides, and events without times may match. Elsewhere
    both need times, and an iou of the threshold, or ends within the tolerance of
    each other, with the iou that they have, even 0.
    """
    one, rest = videos.where("level = 1").select("video_id"), videos.where("level > 1").select("video_id")
    timed = lambda df: df.join(rest, "video_id", "left_semi").where("t0 IS NOT NULL AND t1 IS NOT NULL")
    both = sides(timed(truth), timed(pred), (tolerance or 0.0) if threshold > 0 else None)
    score = iou("g0", "g1", "p0", "p1")
    ok = score >= threshold
    if tolerance is not None:
        ok = ok | within("g0", "g1", "p0", "p1", tolerance)
    pairs = both.where(ok).select("video_id", "class_name", "island", "gi", "pi", score.alias("iou"))
    untimed = by_class(truth.join(one, "video_id", "left_semi"), pred.join(one, "video_id", "left_semi"))
    return greedy_match(pairs).unionByName(untimed)


def interval_join(a: DataFrame, b: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Spans (a0, a1) and (b0, b1) of equal keys that each start before the other ends, through bins of `width`: a pair meets in the bin where the later one starts.

    So an empty span inside another one meets it, though they share no length.
    For keys so hot that the product of a key's rows is too much.
    """
    bins = lambda x, y: F.sequence(F.floor(F.col(x) / width), F.floor(F.col(y) / width))
    x = a.withColumn("_bin", F.explode(bins("a0", "a1")))
    y = b.withColumn("_bin", F.explode(bins("b0", "b1")))
    met = x.join(y, [*keys, "_bin"]).where(F.col("_bin") == F.floor(F.greatest("a0", "b0") / width))
    return met.where((F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1"))).drop("_bin")


def greedy_match(pairs: DataFrame) -> DataFrame:
    """One-to-one: pairs in order of (-iou, gi, pi), each taken if both sides are free.

    Islands never compete, so the fold runs over one island's candidates (those
    of a video and class where there is no island); that is what bounds memory.
    """
    keys = ["video_id", "class_name", *(["island"] if "island" in pairs.columns else [])]
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("o"), "gi", "pi", "iou")))
    kind = "struct<gs:array<int>,ps:array<int>,taken:array<struct<gi:int,pi:int,iou:double>>>"
    empty = F.from_json(F.lit('{"gs":[],"ps":[],"taken":[]}'), kind)

    def step(s, x):
        free = ~F.array_contains(s["gs"], x["gi"]) & ~F.array_contains(s["ps"], x["pi"])
        took = F.struct(
            F.array_append(s["gs"], x["gi"]).alias("gs"),
            F.array_append(s["ps"], x["pi"]).alias("ps"),
            F.array_append(s["taken"], F.struct(x["gi"].alias("gi"), x["pi"].alias("pi"), x["iou"].alias("iou"))).alias("taken"),
        )
        return F.when(free, took).otherwise(s)

    pairs = pairs.select(*keys, F.col("gi").cast("int").alias("gi"), F.col("pi").cast("int").alias("pi"), "iou")
    found = pairs.groupBy(*keys).agg(F.aggregate(ordered, empty, step)["taken"].alias("taken"))
    return found.select("video_id", "class_name", F.explode("taken").alias("m")).select("video_id", "class_name", "m.gi", "m.pi", "m.iou")


def verdicts(truth: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """A row per event of either side: video_id, class_name, verdict hit, miss or false_alarm."""
    hit = matches.select("video_id", "gi", F.lit(1).alias("hit"))
    g = truth.join(hit, ["video_id", "gi"], "left").select("video_id", "class_name", F.when(F.col("hit") == 1, "hit").otherwise("miss").alias("verdict"))
    fa = pred.join(matches.select("video_id", "pi"), ["video_id", "pi"], "left_anti").select("video_id", "class_name", F.lit("false_alarm").alias("verdict"))
    return g.unionByName(fa)


def tally(rows: DataFrame, *keys: str) -> DataFrame:
    counts = [F.count_if(F.col("verdict") == v).alias(n) for n, v in (("tp", "hit"), ("fa", "false_alarm"), ("miss", "miss"))]
    return rows.groupBy(*keys).agg(*counts)


def rated(t: DataFrame, empty=1.0) -> DataFrame:
    """A tally with precision, recall and F1; 0/0 counts as `empty`."""
    return t.withColumn("precision", precision("tp", "fa", empty)).withColumn("recall", recall("tp", "miss", empty)).withColumn("f1", f1("tp", "fa", "miss"))


def levels(spark) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in MARKS.items()], "level int, marks double")


def by_level(rows: DataFrame, videos: DataFrame) -> DataFrame:
    """level, marks, tp, fa, miss; every level is there."""
    t = tally(rows.join(videos, "video_id"), "level")
    return F.broadcast(levels(rows.sparkSession)).join(t, "level", "left").na.fill(0, ["tp", "fa", "miss"])


def per_video_credit(rows: DataFrame, videos: DataFrame, credit: Credit) -> DataFrame:
    """level, videos, mean_credit, marks: the mean of the credit of each video, times the level's marks."""
    t = videos.join(tally(rows, "video_id"), "video_id", "left").na.fill(0, ["tp", "fa", "miss"])
    t = t.withColumn("credit", credit(F.col("tp"), F.col("fa"), F.col("miss"))).groupBy("level").agg(F.count("*").alias("videos"), F.avg("credit").alias("mean_credit"))
    return levels(rows.sparkSession).withColumnRenamed("marks", "_m").join(t, "level").select("level", "videos", "mean_credit", (F.col("mean_credit") * F.col("_m")).alias("marks"))


def consensus(runs: DataFrame, duration: float, least_runs: int = 2, share: float = 0.1) -> DataFrame:
    """Events of several runs that agree: each, in order of start, joins the first seed that it shares `share` of the longer one's length with, else is a seed.

    A seed and what joins it overlap, so each island of overlapping events is folded by itself.
    Clusters of at least so many runs stay, as video_id, class_name, t0, t1, confidence, n_agree.
    """
    row = "struct<t0:double,t1:double,event_id:bigint,run:bigint,confidence:double>"
    seed = "struct<s0:double,s1:double,t0:double,t1:double,confidence:double,runs:array<bigint>>"

    def joins(s, x) -> Column:
        longest = F.greatest(s["s1"] - s["s0"], x["t1"] - x["t0"])
        return (longest > 0) & (overlap(s["s0"], s["s1"], x["t0"], x["t1"]) >= share * longest)

    def step(acc, x):
        at = F.array_position(F.transform(acc, lambda s: joins(s, x)), F.lit(True))
        new = F.struct(x["t0"].alias("s0"), x["t1"].alias("s1"), x["t0"].alias("t0"), x["t1"].alias("t1"), x["confidence"].alias("confidence"), F.array(x["run"]).alias("runs"))
        put = lambda s: F.struct(s["s0"], s["s1"], F.least(s["t0"], x["t0"]).alias("t0"), F.greatest(s["t1"], x["t1"]).alias("t1"), F.greatest(s["confidence"], x["confidence"]).alias("confidence"), F.array_union(s["runs"], F.array(x["run"])).alias("runs"))
        return F.when(at == 0, F.array_append(acc, new)).otherwise(F.transform(acc, lambda s, i: F.when(i + 1 == at, put(s)).otherwise(s)))

    start = F.from_json(F.lit("[]"), f"array<{seed}>")
    reach = F.max("t1").over(Window.partitionBy("video_id", "class_name").orderBy("t0").rowsBetween(Window.unboundedPreceding, -1))
    runs = number_runs(runs, ["video_id", "class_name"], ["t0"], F.col("t0") > reach, "island")
    lists = runs.groupBy("video_id", "class_name", "island").agg(F.array_sort(F.collect_list(F.struct("t0", "t1", "event_id", "run", "confidence"))).cast(f"array<{row}>").alias("xs"))
    found = lists.select("video_id", "class_name", F.explode(F.aggregate("xs", start, lambda a, x: step(a, x).cast(f"array<{seed}>"))).alias("c"))
    out = found.select("video_id", "class_name", "c.t0", F.least(F.col("c.t1"), F.lit(duration)).alias("t1"), "c.confidence", F.size("c.runs").alias("n_agree"))
    return out.where(F.col("n_agree") >= least_runs)
