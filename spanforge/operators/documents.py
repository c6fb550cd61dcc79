"""Model answers and submission documents: tolerant parsing, building, validating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import col

EVENT = "array<variant>"


def json_part(text: Column) -> Column:
    """From the first { to the last }; so code fences around it go, and those inside an explanation stay."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def parse_answers(df: DataFrame, keys: list[str], text: str, win, classes: list[str]) -> DataFrame:
    """keys, ord, class_name, t0, t1, confidence, explanation of the events in a model's answers, in window time.

    What is no JSON object with a list `events` has none; elements that are no
    objects or of an unknown class are left out. A missing or zero end means the
    window's end, times that can't be cast the whole window; times are cut to
    the window and an empty span becomes one of a unit or what is left of it.
    """
    w = col(win).cast("double")
    body = F.try_parse_json(json_part(col(text)))
    events = F.try_variant_get(body, "$.events", EVENT)
    rows = df.select(*keys, w.alias("_w"), F.posexplode(events).alias("ord", "_e"))
    got = lambda p, t: F.try_variant_get("_e", p, t)
    rows = rows.where(F.schema_of_variant("_e").startswith("OBJECT")).select(
        *keys,
        "ord",
        "_w",
        F.trim(got("$.class_name", "string")).alias("class_name"),
        got("$.start", "string").alias("_s"),
        got("$.end", "string").alias("_t"),
        F.coalesce(got("$.confidence", "double"), F.lit(0.5)).alias("_c"),
        F.substring(F.coalesce(got("$.explanation", "string"), F.lit("")), 1, 480).alias("explanation"),
    )
    a, b = F.expr("try_cast(_s AS double)"), F.expr("try_cast(_t AS double)")
    bad = (F.col("_s").isNotNull() & a.isNull()) | (F.col("_t").isNotNull() & b.isNull())
    a = F.when(bad, 0.0).otherwise(F.coalesce(a, F.lit(0.0)))
    b = F.when(bad, F.col("_w")).otherwise(F.when(F.coalesce(b, F.lit(0.0)) == 0, F.col("_w")).otherwise(b))
    cut = lambda x: F.greatest(F.lit(0.0), F.least(x, F.col("_w")))
    rows = rows.where(F.col("class_name").isin(classes)).withColumn("t0", cut(a)).withColumn("t1", cut(b))
    t1 = F.when(F.col("t1") <= F.col("t0"), F.least(F.col("_w"), F.col("t0") + 1)).otherwise(F.col("t1"))
    return rows.select(*keys, "ord", "class_name", "t0", t1.alias("t1"), F.greatest(F.lit(0.0), F.least(F.col("_c"), F.lit(1.0))).alias("confidence"), "explanation")


def rejects(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and why an answer has no list of events: empty, no json, no events."""
    body = F.try_parse_json(json_part(col(text)))
    events = F.try_variant_get(body, "$.events", EVENT)
    why = F.when(F.coalesce(F.trim(col(text)), F.lit("")) == "", "empty").when(body.isNull(), "no json").when(events.isNull(), "no events")
    return df.select(*keys, why.alias("reason")).where("reason IS NOT NULL")


def answer_json(events: Column) -> Column:
    """The canonical answer for an array of (class_name, start, end, confidence, explanation)."""
    return F.to_json(F.struct(events.alias("events")))


def violations(rows: DataFrame, videos: DataFrame, classes: list[str]) -> DataFrame:
    """problem, video_id, ord of a submission's rows (video_id, entry, ord, class_name, t0, t1, explanation); `entry` counts a video's entries.

    ord is -1 where the problem is no row's.
    Rows of unknown videos and of a video's second entry are not looked at further.
    """
    v = videos.select("video_id", "level", "duration")
    known = rows.join(v, "video_id")
    first = known.where("entry = 0")
    out = lambda df, p: df.select(F.lit(p).alias("problem"), "video_id", F.col("ord").cast("long").alias("ord"))
    early = first.where(F.col("class_name").isNotNull())
    checks = [
        out(rows.join(v, "video_id", "left_anti").where("entry = 0"), "unknown id"),
        out(known.where("entry > 0"), "duplicate id"),
        out(early.where(~F.col("class_name").isin(classes)), "class not in vocabulary"),
        out(early.where("level = 1 AND (t0 IS NOT NULL OR t1 IS NOT NULL)"), "times on level 1"),
        out(early.where("level > 1 AND (t0 IS NULL OR t1 IS NULL OR NOT (0 <= t0 AND t0 < t1 AND t1 <= duration))"), "bad times"),
        out(early.where("explanation IS NOT NULL AND NOT (length(explanation) BETWEEN 20 AND 500)"), "explanation length"),
        v.join(rows, "video_id", "left_anti").select(F.lit("missing id").alias("problem"), "video_id", F.lit(-1).cast("long").alias("ord")),
    ]
    all_ = checks[0]
    for c in checks[1:]:
        all_ = all_.unionByName(c)
    return all_


def submission_events(df: DataFrame, videos: DataFrame, top: int = 1) -> DataFrame:
    """Rows of a submission: known videos, the `top` most confident on level 1 without times, spans cut to the duration elsewhere; short explanations go."""
    from ..functions.spans import clamp_span

    rows = df.join(videos, ["video_id"])
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "event_id"))
    rows = rows.withColumn("_rank", rank).where((F.col("level") > 1) | (F.col("_rank") <= top))
    a, b = clamp_span("t0", "t1", "duration")
    timed = F.col("level") > 1
    text = F.trim("explanation")
    return rows.select("video_id", "level", "event_id", "class_name", F.when(timed, a).alias("t0"), F.when(timed, b).alias("t1"), F.when(F.length(text) >= 20, text).alias("explanation"))


def submission_json(rows: DataFrame, manifest: DataFrame, submission_id: str, model_name: str) -> DataFrame:
    """video_id, prediction: one JSON document per video in the manifest's order, videos without events with an empty list."""
    e = F.struct("class_name", F.col("t0").alias("start_time_sec"), F.col("t1").alias("end_time_sec"), "explanation")
    lists = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("event_id", e.alias("e")))).alias("x"))
    out = manifest.join(lists, "video_id", "left").orderBy("manifest_ord")
    events = F.coalesce(F.transform("x", lambda s: s["e"]), F.from_json(F.lit("[]"), "array<struct<class_name:string,start_time_sec:double,end_time_sec:double,explanation:string>>"))
    head = [F.lit(submission_id).alias("submission_id"), F.lit(model_name).alias("model_name")]
    return out.select("video_id", F.to_json(F.struct(*head, "video_id", events.alias("events")), {"ignoreNullFields": "false"}).alias("prediction"))


def answers_of(rows: DataFrame, key: str) -> DataFrame:
    """key, answer: the canonical answer of rows (key, ord, class_name, start, end, confidence, explanation): two decimals, confidence 1 where there is none, at most 300 characters of explanation."""
    two = lambda c: F.round(F.col(c).cast("double"), 2).alias(c)
    c = F.round(F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)), 2).alias("confidence")
    e = F.struct("class_name", two("start"), two("end"), c, F.substring(F.coalesce("explanation", F.lit("")), 1, 300).alias("explanation"))
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", e.alias("e")))).alias("x"))
    return lists.select(key, answer_json(F.transform("x", lambda s: s["e"])).alias("answer"))


def sft_sample(system: Column, user: Column, answer: Column, video: Column) -> Column:
    """A training row: the messages of the three roles, and the video that the user's begins with."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.struct(F.array(said("system", system), said("user", F.concat(F.lit("<video>"), user)), said("assistant", answer)).alias("messages"), F.array(video).alias("videos"))


RUNTIME = "struct<frames_processed:bigint,chunks_processed:bigint,end_to_end_internal_time_ms:double,model_runtimes:array<struct<model_name:string,call_count:bigint,total_time_ms:double>>>"


def submission_entries(rows: DataFrame, manifest: DataFrame, runtimes: DataFrame | None = None) -> DataFrame:
    """manifest_ord, video_id, entry: the JSON of each video of the manifest, in its order, with an empty list where there are no rows (video_id, ord, class_name, t0, t1, explanation).

    Times are written even where they are null, explanations only where there is
    one. Videos without a row in runtimes (video_id, runtime) have the default.
    """
    # null fields are left out of an event's JSON but for the two times, so these are written by hand
    bare = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""))
    rest = F.regexp_replace(F.to_json(F.struct(F.nullif("explanation", F.lit("")).alias("explanation"))), r"^\{(.*)\}$", "$1")
    head = F.regexp_replace(F.to_json(F.struct("class_name")), r"\}$", "")
    event = F.concat(head, F.lit(',"start_time_sec":'), bare("t0"), F.lit(',"end_time_sec":'), bare("t1"), F.when(rest != "", F.concat(F.lit(","), rest)).otherwise(""), F.lit("}"))
    lists = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("ord", event.alias("e")))).alias("x"))
    out = manifest.join(lists, "video_id", "left")
    default = F.struct(F.lit(0).cast("long").alias("frames_processed"), F.lit(1).cast("long").alias("chunks_processed"), F.lit(0.0).alias("end_to_end_internal_time_ms"), F.from_json(F.lit("[]"), "array<struct<model_name:string,call_count:bigint,total_time_ms:double>>").alias("model_runtimes"))
    if runtimes is not None:
        out = out.join(runtimes.select("video_id", F.col("runtime").cast(RUNTIME).alias("runtime")), "video_id", "left").withColumn("runtime", F.coalesce("runtime", default))
    else:
        out = out.withColumn("runtime", default)
    events = F.concat(F.lit("["), F.array_join(F.coalesce(F.transform("x", lambda s: s["e"]), F.array().cast("array<string>")), ","), F.lit("]"))
    entry = F.concat(F.regexp_replace(F.to_json(F.struct("video_id")), r"\}$", ""), F.lit(',"events":'), events, F.lit(',"runtime_metadata":'), F.to_json("runtime"), F.lit("}"))
    return out.select("manifest_ord", "video_id", entry.alias("entry")).orderBy("manifest_ord")
