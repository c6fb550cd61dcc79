"""Queries on policies by level, predictions of videos, tracks, motion, reports, planning and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import documents as D
from ..operators import matching as M
from ..operators import motion as N
from ..operators import predict as P
from ..operators import report as R
from ..operators import signals as G
from ..operators import synth as Y
from ..operators import timeline as T
from ..operators import tracks as K
from . import tables as B
from .more import EGO, HOURLY, TRACKS, Z
from .registry import BY_LEVEL, F1, GREEDY, IOU, RATES, SPANS, TALLY, TRUTH_RAW, merged_sql, query

# matching under the policy of each level

POLICY = f"""{SPANS}, {TRUTH_RAW},
o0 AS (SELECT g.video_id, g.class_name, gi, pi, CASE WHEN g.video_id % 3 = 0 THEN 1.0::DOUBLE ELSE {IOU} END AS iou, g.video_id % 3 = 0 OR {IOU} >= 0.3 OR (abs(g.t0 - p.t0) <= 15 AND abs(g.t1 - p.t1) <= 15) AS ok FROM g JOIN p ON g.video_id = p.video_id AND g.class_name = p.class_name),
c AS (SELECT video_id, class_name, gi, pi, iou, row_number() OVER (PARTITION BY video_id, class_name ORDER BY iou DESC, gi, pi) AS rn FROM o0 WHERE ok)"""
POLICY_MATCHED = f"WITH RECURSIVE {POLICY}, {GREEDY}"
VERDICTS = """v AS (SELECT g.video_id, g.class_name, CASE WHEN m.gi IS NULL THEN 'miss' ELSE 'hit' END AS verdict FROM g LEFT JOIN m ON g.video_id = m.video_id AND g.gi = m.gi
 UNION ALL SELECT p.video_id, p.class_name, 'false_alarm' FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.video_id = p.video_id AND m.pi = p.pi))"""


def by_policy(spark, d):
    """Truth, predictions and their matches: class alone on level 1, iou 0.3 or ends within 15 hours elsewhere."""
    g, p = M.indexed(B.truth(spark, d), "gi"), M.indexed(B.predictions(spark, d), "pi")
    return g, p, M.match_by_level(g, p, B.videos(spark, d), 0.3, 15.0)


@query(f"{POLICY_MATCHED} SELECT video_id, class_name, CAST(gi AS INTEGER) AS gi, CAST(pi AS INTEGER) AS pi, iou FROM m")
def policy_match(spark, d):
    return by_policy(spark, d)[2]


@query(f"{POLICY_MATCHED} SELECT video_id, class_name, CAST(gi AS INTEGER) AS gi, CAST(pi AS INTEGER) AS pi, iou FROM m ORDER BY video_id, gi")
def policy_match_in_order(spark, d):
    """The matches of each video in the order of the truth."""
    return policy_match(spark, d).orderBy("video_id", "gi")


@query(f"{POLICY_MATCHED}, {VERDICTS}, {BY_LEVEL} SELECT * FROM s")
def policy_score_by_level(spark, d):
    return M.rated(M.by_level(M.verdicts(*by_policy(spark, d)), B.videos(spark, d)))


@query(f"{POLICY_MATCHED}, {VERDICTS}, t AS (SELECT class_name, {TALLY} FROM v GROUP BY 1), rt AS (SELECT *, {RATES} FROM t) SELECT *, {F1} FROM rt")
def policy_score_by_class(spark, d):
    return M.rated(M.tally(M.verdicts(*by_policy(spark, d)), "class_name"))


# what a page shows of a run: the videos whose id 7 divides have failed, those with a rest of 1 have not been run

STATES = "st AS (SELECT DISTINCT user_id AS video_id, 1 + user_id % 3 AS level, 800.0::DOUBLE AS duration, CASE user_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'not_run' ELSE 'ok' END AS state FROM events)"


def states(spark, d):
    v = B.videos(spark, d).withColumn("duration", F.lit(800.0))
    rows = v.where("video_id % 7 <> 1").select("video_id", F.when(F.col("video_id") % 7 == 0, "out of memory").alias("failed"))
    return R.states(v, rows)


@query(f"WITH {STATES} SELECT count(*) FILTER (state = 'ok') AS videos_predicted, count(*) FILTER (state = 'failed') AS videos_failed, count(*) FILTER (state = 'not_run') AS videos_not_run, count(*) AS videos_total FROM st")
def run_totals(spark, d):
    return R.run_totals(states(spark, d))


SHOWN = f"""{STATES}, okm AS (SELECT m.* FROM m JOIN st ON st.video_id = m.video_id WHERE state = 'ok'),
gs AS (SELECT g.video_id, g.gi, g.class_name, g.t0 AS start, g.t1 AS "end", true AS localised, CASE WHEN state <> 'ok' THEN 'pending' WHEN okm.pi IS NULL THEN 'miss' ELSE 'hit' END AS verdict, okm.iou, coalesce(okm.pi, -1) AS pair FROM g JOIN st ON st.video_id = g.video_id LEFT JOIN okm ON okm.video_id = g.video_id AND okm.gi = g.gi),
ps AS (SELECT p.video_id, p.pi, p.class_name, p.t0 AS start, p.t1 AS "end", CASE WHEN okm.gi IS NULL THEN 'false_alarm' ELSE 'hit' END AS verdict, okm.iou, coalesce(okm.gi, -1) AS pair, CASE WHEN okm.gi IS NOT NULL AND st.level = 1 THEN round({IOU.replace('p.t0', 'p.t0').replace('p.t1', 'p.t1')}, 3) END AS iou_untimed
 FROM p JOIN st ON st.video_id = p.video_id AND state = 'ok' LEFT JOIN okm ON okm.video_id = p.video_id AND okm.pi = p.pi LEFT JOIN g ON g.video_id = p.video_id AND g.gi = okm.gi)"""


def shown(spark, d):
    g, p, m = by_policy(spark, d)
    s = states(spark, d)
    m = m.join(s.where("state = 'ok'").select("video_id"), "video_id", "left_semi")
    t = R.truth_shown(g, m, s)
    return t, R.model_shown(p, t, m, s)


def ints(df, *columns):
    """Places as longs, -1 for none."""
    for c in columns:
        df = df.withColumn(c, F.coalesce(F.col(c).cast("long"), F.lit(-1)))
    return df


@query(f"{POLICY_MATCHED}, {SHOWN} SELECT * FROM gs")
def shown_truth(spark, d):
    return ints(shown(spark, d)[0], "gi", "pair")


@query(f"{POLICY_MATCHED}, {SHOWN} SELECT * FROM ps")
def shown_model(spark, d):
    return ints(shown(spark, d)[1], "pi", "pair")


@query(f"{POLICY_MATCHED}, {SHOWN} SELECT class_name, count(*) FILTER (verdict = 'hit') AS hit, count(*) FILTER (verdict <> 'hit') AS fa FROM ps GROUP BY 1 ORDER BY fa DESC, class_name LIMIT 8")
def class_bars(spark, d):
    return R.class_bars(shown(spark, d)[1])


@query("SELECT round(sum(value), 4) AS total_wall_time_ms, count(*) AS calls FROM events")
def wall_time(spark, d):
    return B.table(spark, d, "events").agg(F.round(F.sum("value"), 4).alias("total_wall_time_ms"), F.count("*").alias("calls"))


@query("WITH w AS (SELECT user_id AS video_id, floor(value / 10) * 10::DOUBLE AS w0, floor(value / 10) * 10 + 20::DOUBLE AS w1 FROM events) SELECT DISTINCT video_id, w0::DOUBLE AS w0, w1::DOUBLE AS w1 FROM w")
def window_grid(spark, d):
    """The windows of events of one kind and of the others, each once."""
    at = (F.floor(F.col("value") / 10) * 10).cast("double")
    w = B.table(spark, d, "events").select(F.col("user_id").alias("video_id"), "event_type", at.alias("w0"), (at + 20).alias("w1"))
    return R.window_grid(w.where("event_type = 'click'"), w.where("event_type <> 'click'"))


@query("WITH r AS (SELECT 0 AS source, user_id AS video_id, event_id FROM events WHERE event_type = 'signup' UNION ALL SELECT 1, user_id, event_id FROM events WHERE event_type = 'purchase' UNION ALL SELECT 2, user_id, event_id FROM events) SELECT * FROM r WHERE source = (SELECT min(source) FROM r x WHERE x.video_id = r.video_id)")
def first_answer(spark, d):
    e = B.table(spark, d, "events").select(F.col("user_id").alias("video_id"), "event_id", "event_type")
    out = R.first_answer([e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), e], "video_id")
    return out.select("source", "video_id", "event_id")


@query("SELECT CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS INTEGER) AS run, event_id, user_id FROM events WHERE event_type IN ('click', 'view', 'error')")
def union_runs(spark, d):
    e = B.table(spark, d, "events")
    return R.union_runs([e.where(F.col("event_type") == t).select("event_id", "user_id") for t in ("click", "view", "error")]).select("run", "event_id", "user_id")


# predictions


@query(f"""WITH {SPANS}, {merged_sql('m', '''class_name <> 'signup' AND confidence >= 0.5 AND video_id IN (SELECT video_id FROM spans GROUP BY 1 HAVING max(t1) > 780)''', 6)},
b AS (SELECT video_id, class_name, confidence, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, event_id) AS k FROM spans WHERE class_name <> 'signup' AND confidence >= 0.5 AND video_id IN (SELECT video_id FROM spans GROUP BY 1 HAVING max(t1) <= 780))
SELECT video_id, class_name, t0, t1, confidence FROM m UNION ALL SELECT video_id, class_name, NULL, NULL, confidence FROM b WHERE k = 1""")
def video_events(spark, d):
    return P.video_events(B.spans(spark, d), 0.5, 780.0, normal="signup")


ABSOLUTE = "r AS (SELECT event_id, video_id, floor(t0 / 10) * 10 AS w0, t0 - floor(t0 / 10) * 10 AS a, t1 - floor(t0 / 10) * 10 AS b FROM spans)"


def relative(spark, d):
    w0 = F.floor(F.col("t0") / 10) * F.lit(10.0)
    return B.spans(spark, d).select("event_id", "video_id", w0.alias("w0"), (F.col("t0") - w0).alias("t0"), (F.col("t1") - w0).alias("t1"), F.lit(B.DURATION).alias("duration"))


@query(f"WITH {SPANS}, {ABSOLUTE} SELECT event_id, video_id, round(least(720.0::DOUBLE, w0 + a), 2) AS t0, round(least(720.0::DOUBLE, w0 + b), 2) AS t1 FROM r")
def absolute_times(spark, d):
    return P.absolute(relative(spark, d)).select("event_id", "video_id", "t0", "t1")


@query(f"WITH {SPANS}, {ABSOLUTE} SELECT event_id, video_id, round((w0 + a)::DOUBLE, 2) AS t0, round((w0 + b)::DOUBLE, 2) AS t1 FROM r")
def absolute_times_live(spark, d):
    return P.absolute(relative(spark, d), duration=False).select("event_id", "video_id", "t0", "t1")


@query(f"WITH {SPANS} SELECT video_id, class_name, greatest(0.0::DOUBLE, min(t0) - 60) AS t0, least(720.0::DOUBLE, max(t1) + 60) AS t1, max(confidence) AS confidence FROM spans GROUP BY 1, 2")
def span_policy(spark, d):
    return P.span_policy(B.spans(spark, d), B.DURATION, 60.0)


@query("SELECT event_id, user_id FROM events ORDER BY value DESC, event_id LIMIT 40 OFFSET 25")
def skip_limit(spark, d):
    return P.page_of(B.table(spark, d, "events"), [F.desc("value"), "event_id"], 25, 40).select("event_id", "user_id")


@query("WITH k AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events) SELECT event_id, user_id FROM k WHERE place % 6 = 0")
def stride_frames(spark, d):
    """Every sixth event of a user, as 5 of 30 frames a second are."""
    e = B.table(spark, d, "events")
    return K.every_nth(e, ["user_id"], ["ts", "event_id"], F.lit(30.0), 5.0).select("event_id", "user_id")


# as-of look-ups


@query(f"WITH {SPANS}, m AS (SELECT video_id, t0 AS mark FROM spans WHERE class_name = 'error'), p AS (SELECT * FROM spans WHERE class_name <> 'error'), f AS (SELECT video_id, min(mark) AS first FROM m GROUP BY 1), a AS (SELECT p.event_id, p.video_id, m.mark FROM p ASOF LEFT JOIN m ON p.video_id = m.video_id AND p.t0 >= m.mark) SELECT event_id, a.video_id, coalesce(mark, first) AS mark FROM a LEFT JOIN f ON f.video_id = a.video_id")
def asof_window_or_first(spark, d):
    """The window under the playhead: the last that has begun, before all the first."""
    s = B.spans(spark, d)
    marks = s.where("class_name = 'error'").select("video_id", F.col("t0").alias("mark"))
    return T.as_of(s.where("class_name <> 'error'").select("event_id", "video_id", "t0"), marks, "video_id", "t0", "mark", nearest=True).select("event_id", "video_id", "mark")


@query(f"WITH {SPANS}, m AS (SELECT video_id, t0 AS mark FROM spans WHERE class_name = 'error'), p AS (SELECT event_id, video_id, t0 - 0.2::DOUBLE AS t FROM spans WHERE class_name <> 'error') SELECT p.event_id, p.video_id, m.mark FROM p ASOF LEFT JOIN m ON p.video_id = m.video_id AND p.t >= m.mark")
def previous_marker(spark, d):
    s = B.spans(spark, d)
    marks = s.where("class_name = 'error'").select("video_id", F.col("t0").alias("mark"))
    p = s.where("class_name <> 'error'").select("event_id", "video_id", (F.col("t0") - 0.2).alias("t"))
    return T.as_of(p, marks, "video_id", "t", "mark").select("event_id", "video_id", "mark")


# tracks: a user is a video, an event type an object, moments are days

CLS = "CASE class_name WHEN 'click' THEN 2 WHEN 'view' THEN 7 WHEN 'signup' THEN 3 WHEN 'error' THEN 1 ELSE 0 END"
RUNS_OF = """f{k} AS (SELECT *, lag(still) OVER (PARTITION BY video_id, class_name ORDER BY t, event_id) AS before FROM sp WHERE n >= 3 AND {where}),
r{k} AS (SELECT *, sum(CASE WHEN NOT still OR NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, class_name ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f{k}),
e{k} AS (SELECT video_id, cls, min(t) AS a, max(t) AS b FROM r{k} WHERE still GROUP BY video_id, class_name, cls, run HAVING max(t) - min(t) >= {least})"""
DERIVED = f"""{TRACKS}, {EGO}, sp AS (SELECT ve.video_id, ve.class_name, ve.t, ve.event_id, {CLS} AS cls, day, sqrt(pow(vx - ex, 2) + pow(vy - ey, 2)) / 100 AS speed, sqrt(pow(vx - ex, 2) + pow(vy - ey, 2)) / 100 < 0.004 AS still, count(*) OVER (PARTITION BY ve.video_id, ve.class_name) AS n
 FROM ve JOIN ego ON ego.video_id = ve.video_id AND ego.day = floor(ve.t / 24)),
{RUNS_OF.format(k=1, where='cls > 0', least=8)}, {RUNS_OF.format(k=2, where='cls = 0', least=12)},
ct AS (SELECT video_id, floor(t / 24)::BIGINT AS day, count(*) AS vehicles FROM tr WHERE {CLS} > 0 GROUP BY 1, 2),
h AS (SELECT ct.video_id, ct.day, vehicles, coalesce((SELECT median(speed) FROM sp WHERE sp.video_id = ct.video_id AND sp.day = ct.day AND cls > 0), 0) AS speed FROM ct),
u AS (SELECT video_id, coalesce(median(speed) FILTER (speed > 0), 1e-6) AS usual FROM h GROUP BY 1),
fl AS (SELECT h.video_id, day, vehicles, vehicles >= 3 AND speed < 0.45 * usual AS flag FROM h JOIN u ON u.video_id = h.video_id),
f3 AS (SELECT *, lag(flag) OVER (PARTITION BY video_id ORDER BY day) AS before FROM fl),
r3 AS (SELECT *, sum(CASE WHEN NOT flag OR NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM f3),
e3 AS (SELECT video_id, min(day)::DOUBLE AS a, max(day)::DOUBLE AS b, max(vehicles) AS peak FROM r3 WHERE flag GROUP BY video_id, run HAVING max(day) - min(day) >= 1),
ev AS (SELECT video_id, 'stalled_or_broken_down_vehicle' AS class_name, round(a, 2) AS t0, round(b, 2) AS t1, round(round(least(0.9, 0.4 + (b - a) / 60)::DOUBLE, 9), 2)::DOUBLE AS confidence, 'A ' || CASE cls WHEN 1 THEN 'bicycle' WHEN 2 THEN 'car' WHEN 3 THEN 'motorcycle' WHEN 5 THEN 'bus' ELSE 'truck' END || ' remains stationary for ' || printf('%.0f', b - a) || ' seconds while other traffic continues around it.' AS explanation FROM e1
 UNION ALL SELECT video_id, 'loitering_or_suspicious_presence', round(a, 2), round(b, 2), round(round(least(0.9, 0.4 + (b - a) / 60)::DOUBLE, 9), 2)::DOUBLE, 'A person stays in the same location for ' || printf('%.0f', b - a) || ' seconds without moving on.' FROM e2
 UNION ALL SELECT video_id, 'traffic_congestion', a, b, 0.6, 'Vehicle density rises to ' || peak || ' while median speed falls to under half the scene baseline, sustained for ' || printf('%.0f', b - a) || ' seconds.' FROM e3),
mb AS (SELECT *, CASE WHEN t0 - max(t1) OVER (PARTITION BY video_id, class_name ORDER BY t0, t1, explanation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 2 THEN 0 ELSE 1 END AS b FROM ev),
mr AS (SELECT *, sum(b) OVER (PARTITION BY video_id, class_name ORDER BY t0, t1, explanation ROWS UNBOUNDED PRECEDING) AS run FROM mb),
mg AS (SELECT video_id, class_name, min(t0) AS t0, max(t1) AS t1, max(confidence)::DOUBLE AS confidence, arg_min(explanation, (t0, t1, explanation)) AS explanation FROM mr GROUP BY video_id, class_name, run)"""


def derived(spark, d):
    c = F.col("class_name")
    cls = F.when(c == "click", 2).when(c == "view", 7).when(c == "signup", 3).when(c == "error", 1).otherwise(0)
    points = B.tracks(spark, d).select("video_id", c.alias("track_id"), cls.alias("cls_id"), "event_id", "t", "x", "y")
    return K.derive_events(points, F.lit(100.0), vehicles=3, jam=1.0, moment=lambda t: F.floor(t / 24).cast("long"))


@query(f"WITH {DERIVED} SELECT video_id, class_name, t0, t1, confidence FROM mg")
def track_events(spark, d):
    """Events of still vehicles, lingering people and congestion, merged by class."""
    return derived(spark, d).drop("explanation")


@query(f"WITH {DERIVED} SELECT class_name, count(*) AS n, count(DISTINCT explanation) AS texts FROM mg WHERE length(explanation) >= 20 GROUP BY 1")
def track_event_texts(spark, d):
    return derived(spark, d).where("length(explanation) >= 20").groupBy("class_name").agg(F.count("*").alias("n"), F.countDistinct("explanation").alias("texts"))


# motion: a user's events of a day are the blocks of a frame, x the value, y the confidence

FRAMES = f"{SPANS}, bl AS (SELECT video_id, floor(t0 / 24)::BIGINT AS day, value AS x, confidence * 100 AS y, abs(value - 30) AS residual, value > 30 AS outlier FROM spans)"


def blocks(spark, d):
    s = B.spans(spark, d)
    return s.select("video_id", F.floor(F.col("t0") / 24).cast("long").alias("day"), F.col("value").alias("x"), (F.col("confidence") * 100).alias("y"), F.abs(F.col("value") - 30).alias("residual"), (F.col("value") > 30).alias("outlier"))


@query(f"""WITH {FRAMES}, a AS (SELECT video_id, day, count(*) AS blocks, count(*) FILTER (outlier) AS k, coalesce(sum(residual) FILTER (outlier), 0) AS r, stddev_pop(x) FILTER (outlier) AS sx, stddev_pop(y) FILTER (outlier) AS sy FROM bl GROUP BY 1, 2)
SELECT video_id, day, blocks, round(r / 200 / blocks * 1000, 6) AS residual, k / blocks::DOUBLE AS outlier_frac, round(CASE WHEN k >= 3 THEN sqrt(sx * sx + sy * sy) / 200 ELSE 0 END::DOUBLE, 6) AS spread FROM a""")
def frame_stats(spark, d):
    t = N.frame_stats(blocks(spark, d), ["video_id", "day"], 200.0)
    return t.withColumn("residual", F.round("residual", 6)).withColumn("spread", F.round("spread", 6))


@query(f"""WITH RECURSIVE {FRAMES}, n AS (SELECT video_id, day, count(*) AS n FROM bl GROUP BY 1, 2), cells AS (SELECT DISTINCT video_id, day, floor(x / 32)::BIGINT AS cx, floor(y / 32)::BIGINT AS cy FROM bl),
reach(video_id, day, cx, cy, rx, ry) AS (SELECT video_id, day, cx, cy, cx, cy FROM cells UNION SELECT r.video_id, r.day, r.cx, r.cy, c.cx, c.cy FROM reach r JOIN cells c ON c.video_id = r.video_id AND c.day = r.day AND abs(c.cx - r.rx) <= 1 AND abs(c.cy - r.ry) <= 1),
first AS (SELECT video_id, day, cx, cy, min((rx, ry)) AS f FROM reach GROUP BY 1, 2, 3, 4)
SELECT n.video_id, n.day, CASE WHEN n >= 3 THEN (SELECT count(DISTINCT f) FROM first WHERE first.video_id = n.video_id AND first.day = n.day) ELSE 0 END AS blobs FROM n""")
def motion_blobs(spark, d):
    """Groups of cells of 32 that touch, of each user's events of a day."""
    return N.blobs(blocks(spark, d), ["video_id", "day"])


@query(f"WITH {SPANS} SELECT video_id, floor(t0)::BIGINT AS t, avg(value) AS value, avg(confidence) AS confidence, count(*) AS n FROM spans GROUP BY 1, 2")
def per_second(spark, d):
    return N.per_second(B.spans(spark, d).select("video_id", F.col("t0").alias("at"), "value", "confidence"), ["video_id"], "at", ["value", "confidence"])


@query(f"WITH {HOURLY} SELECT count(*) FILTER (label) / greatest(count(*), 1)::DOUBLE AS base_rate FROM h")
def base_rate(spark, d):
    return B.hourly(spark, d).agg(N.base_rate(None, "label").alias("base_rate"))


@query(f"""WITH {HOURLY}, k AS (SELECT *, rank() OVER (PARTITION BY video_id ORDER BY x) + (count(*) OVER (PARTITION BY video_id, x) - 1) / 2.0::DOUBLE AS r FROM h),
s AS (SELECT video_id, sum(r) FILTER (label) AS s, count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS q FROM k GROUP BY 1), a AS (SELECT CASE WHEN p > 0 AND q > 0 THEN (s - p * (p + 1) / 2) / (p * q) END AS auc FROM s)
SELECT round(avg(auc), 9) AS mean_auc, count(auc) AS n FROM a""")
def mean_auc(spark, d):
    """Over the videos that have both classes."""
    return G.auc(B.hourly(spark, d), ["video_id"], "x", "label").agg(F.round(F.avg("auc"), 9).alias("mean_auc"), F.count("auc").alias("n"))


EXTREMES = "a AS (SELECT user_id AS video_id, median(value) AS mid FROM events GROUP BY 1)"


@query(f"WITH {EXTREMES}, l AS (SELECT 'least' AS \"end\", row_number() OVER (ORDER BY mid, video_id) AS rank, video_id, mid FROM a), m AS (SELECT 'most', row_number() OVER (ORDER BY mid DESC, video_id) AS rank, video_id, mid FROM a) SELECT \"end\", CAST(rank AS INTEGER) AS rank, video_id, mid FROM (SELECT * FROM l UNION ALL SELECT * FROM m) WHERE rank <= 5")
def motion_extremes(spark, d):
    """The five users of least and of greatest median value."""
    return N.extremes(B.table(spark, d, "events").groupBy(F.col("user_id").alias("video_id")).agg(F.median("value").alias("mid")), "mid", "video_id")


@query(f"WITH {HOURLY}, {EXTREMES}, k AS (SELECT mid > 20 AS moving, label FROM h JOIN a ON a.video_id = h.video_id) SELECT moving, count(*) AS hours, count(*) FILTER (label) AS labelled FROM k GROUP BY 1")
def report_by_motion(spark, d):
    """The hours of users with a median value above 20, and of the others."""
    ego = B.table(spark, d, "events").groupBy(F.col("user_id").alias("video_id")).agg((F.median("value") > 20).alias("moving"))
    return B.hourly(spark, d).join(ego, "video_id").groupBy("moving").agg(F.count("*").alias("hours"), F.count_if("label").alias("labelled"))


@query("SELECT event_id, sqrt(pow(value * 2 - (value * 1.5 + user_id * 0.25 + 3), 2) + pow(user_id * 1.25 - (value * -0.5 + user_id + 1), 2)) AS r FROM events")
def affine_residual(spark, d):
    e = B.table(spark, d, "events")
    r = N.residual("value", "user_id", F.col("value") * 2, F.col("user_id") * 1.25, [1.5, 0.25, 3.0, -0.5, 1.0, 1.0])
    return e.select("event_id", r.alias("r"))


@query("SELECT event_id, (user_id + value) / 2 AS x, (value + 2 * value) / 2 AS y FROM events")
def box_centres(spark, d):
    x, y = K.box_centre("user_id", "value", "value", F.col("value") * 2)
    return B.table(spark, d, "events").select("event_id", x.alias("x"), y.alias("y"))


# planning of composed videos: a user is a composition, its events in order are the segments

SEGMENTS = "sg AS (SELECT user_id AS video_id, event_id, value AS duration, CASE WHEN event_type <> 'view' THEN event_type END AS class_name, 0.25::DOUBLE AS label_start, CASE WHEN event_id % 2 = 0 THEN value / 2 END AS label_length, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM events)"


def segments(spark, d):
    e = B.table(spark, d, "events")
    return e.select(F.col("user_id").alias("video_id"), "event_id", F.col("value").alias("duration"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("class_name"), F.lit(0.25).alias("label_start"), F.when(F.col("event_id") % 2 == 0, F.col("value") / 2).alias("label_length"))


@query(f"WITH {SEGMENTS} SELECT video_id, event_id, round(o, 6) AS \"offset\" FROM sg")
def segment_offsets(spark, d):
    return Y.offsets(segments(spark, d), "video_id", "event_id").select("video_id", "event_id", F.round("offset", 6).alias("offset"))


@query(f"""WITH {SEGMENTS}, l AS (SELECT video_id, event_id, class_name, round(o, 6) + label_start AS t0, round(o, 6) + coalesce(label_start + label_length, duration) AS t1 FROM sg WHERE class_name IS NOT NULL),
f AS (SELECT *, CASE WHEN lag(class_name) OVER w = class_name AND t0 - lag(t1) OVER w < 0.75 THEN 0 ELSE 1 END AS b FROM l WINDOW w AS (PARTITION BY video_id ORDER BY t0, event_id)),
r AS (SELECT *, sum(b) OVER (PARTITION BY video_id ORDER BY t0, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f),
q AS (SELECT video_id, class_name, round(min(t0), 3) AS t0, round(arg_max(t1, (t0, event_id)), 3) AS t1, count(*) AS n, arg_max(t1, (t0, event_id)) - min(t0) AS length FROM r GROUP BY video_id, run, class_name) SELECT video_id, class_name, t0, t1, n FROM q WHERE length > 0.5""")
def composed_events(spark, d):
    """The labels of composed videos, those cut by a jump joined again."""
    out = Y.composed_events(segments(spark, d), "video_id", "event_id")
    return out.withColumn("t0", F.round("t0", 3)).withColumn("t1", F.round("t1", 3))


@query("SELECT event_id, user_id % 7 <> 0 AND abs(value * 1.02 - value) <= 0.5 AS kept FROM events")
def duration_gate(spark, d):
    e = B.table(spark, d, "events")
    planned = e.select("event_id", F.col("value").alias("duration"))
    actual = e.where("user_id % 7 <> 0").select("event_id", (F.col("value") * 1.02).alias("duration"))
    kept, dropped = Y.duration_gate(planned, actual, "event_id", 0.5)
    return kept.select("event_id", F.lit(True).alias("kept")).unionByName(dropped.select("event_id", F.lit(False).alias("kept")))


@query("SELECT event_id, event_type AS class_name, value AS real_duration FROM events WHERE value >= 1 AND event_id % 5 <> 0")
def clip_pool(spark, d):
    e = B.table(spark, d, "events")
    return Y.clip_pool(e.select("event_id", F.col("event_type").alias("class_name")), e.select("event_id", F.col("value").alias("duration")), e.where("event_id % 5 <> 0"), "event_id").select("event_id", "class_name", "real_duration")


U = "(('0x' || substr(md5('{seed}/' || {key} || '/{what}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def u(what, key="user_id", seed=5):
    return U.format(seed=seed, key=key, what=what)


@query(f"""WITH v AS (SELECT DISTINCT user_id FROM events), n AS (SELECT user_id, CASE WHEN {u('level')} < 0.6 THEN 2 ELSE 3 END AS level, CASE WHEN {u('empty')} < 0.12 THEN 0 ELSE [1, 1, 2, 2, 3, 4, 6][CAST(floor({u('count')} * 7) AS INTEGER) + 1] END AS n_events, {u('single')} < 0.45 AS one FROM v)
SELECT user_id, CAST(level AS INTEGER) AS level, CAST(n_events AS INTEGER) AS n_events, n_events > 0 AND one AS one_class FROM n""")
def composition_plan(spark, d):
    return Y.plan(B.table(spark, d, "events").select("user_id").distinct(), "user_id", 5)


@query(f"WITH k AS (SELECT event_id, {u('profile', 'event_id')} AS u FROM events) SELECT event_id, CAST(CASE WHEN u < 0.5 THEN 0 WHEN u < 0.8 THEN 1 ELSE 2 END AS INTEGER) AS profile FROM k")
def weighted_profiles(spark, d):
    """One of three profiles for each event, with weights 5, 3 and 2."""
    return B.table(spark, d, "events").select("event_id", Y.weighted(Y.draw(5, "event_id", F.lit("profile")), [5.0, 3.0, 2.0]).alias("profile"))


@query(f"""WITH k AS (SELECT event_id, value / 4 AS t0, CASE WHEN event_id % 3 > 0 THEN value / 2 END AS t1, value + 1 AS real, {u('trim', 'event_id')} AS u FROM events), a AS (SELECT event_id, real, u, least(greatest(0.0::DOUBLE, t0), greatest(0.0::DOUBLE, real - 0.5)) AS a, least(coalesce(t1, real), real) AS b FROM k),
l AS (SELECT *, greatest(0.5::DOUBLE, least(8.0::DOUBLE, b - a)) AS len FROM a), s AS (SELECT *, a + u * greatest(0.0::DOUBLE, b - a - len) AS start FROM l) SELECT event_id, start, greatest(0.5::DOUBLE, least(len, real - start)) AS length FROM s""")
def trim_windows(spark, d):
    """Eight seconds of each clip, inside its event."""
    v = F.col("value")
    start, length = Y.trim(v / 4, F.when(F.col("event_id") % 3 > 0, v / 2), v + 1, F.lit(8.0), Y.draw(5, "event_id", F.lit("trim")))
    return B.table(spark, d, "events").select("event_id", start.alias("start"), length.alias("length"))


@query("""WITH k AS (SELECT event_id, greatest(0.0::DOUBLE, value / 2 - 2) AS a, value + 1 AS b, value * 0.75 AS mid, value / 2 > 8 AS cut FROM events)
SELECT event_id, 0 AS pos, a AS t0, CASE WHEN cut THEN mid - 2 ELSE b END AS t1 FROM k UNION ALL SELECT event_id, 1, mid + 2, b FROM k WHERE cut""")
def event_segments(spark, d):
    """What to cut for each event: with two seconds before and one after, long ones without four seconds in their middle."""
    s = Y.segments(F.col("value") / 2, "value", 2.0, 1.0, jump=4.0)
    return B.table(spark, d, "events").select("event_id", F.posexplode(s).alias("pos", "s")).select("event_id", "pos", "s.t0", "s.t1")


@query("SELECT DISTINCT event_type AS class_name FROM events WHERE event_type IN ('click', 'purchase', 'fire')")
def pool_in_vocabulary(spark, d):
    pool = B.table(spark, d, "events").select(F.col("event_type").alias("class_name")).distinct()
    vocabulary = spark.createDataFrame([("click",), ("purchase",), ("fire",)], "class_name string")
    return pool.join(F.broadcast(vocabulary), "class_name", "left_semi")


# documents


@query("""SELECT user_id AS video_id, count(*) AS n, min(CAST(round(value, 2) AS DOUBLE)) AS least_start, max(CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE round(event_id % 100 / 100.0, 2) END::DOUBLE) AS most_confidence, max(least(300, 25 * (event_id % 20))) AS longest FROM events GROUP BY 1""")
def canonical_answers(spark, d):
    """What the canonical answers hold: times with two decimals, confidence 1 where there is none, at most 300 characters of explanation."""
    e = B.table(spark, d, "events")
    rows = e.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("class_name"), F.col("value").alias("start"), (F.col("value") + 3).alias("end"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 100 / 100.0).alias("confidence"), F.repeat(F.lit("a"), (F.col("event_id") % 20 * 25).cast("int")).alias("explanation"))
    text = D.answers_of(rows, "video_id")
    back = text.select("video_id", F.explode(F.from_json("answer", "events array<struct<class_name:string,start:double,end:double,confidence:double,explanation:string>>")["events"]).alias("e"))
    return back.groupBy("video_id").agg(F.count("*").alias("n"), F.min("e.start").alias("least_start"), F.max("e.confidence").alias("most_confidence"), F.max(F.length("e.explanation")).cast("long").alias("longest"))


@query("SELECT event_id, 'system,user,assistant' AS roles, 1 AS videos, 'This segment is ' || printf('%.1f', value + 0.001) || ' seconds long.' AS line FROM events")
def sft_samples(spark, d):
    """Role and content messages of a training row, and its video."""
    e = B.table(spark, d, "events")
    s = D.sft_sample(F.lit("SYS"), X.prompt("This segment is {w} seconds long.", w=F.col("value") + 0.001), F.lit("{}"), F.concat(F.col("event_id").cast("string"), F.lit(".mp4")))
    m = e.select("event_id", s.alias("s"))
    return m.select("event_id", F.array_join(F.transform("s.messages", lambda x: x["role"]), ",").alias("roles"), F.size("s.videos").alias("videos"), F.replace(F.col("s.messages")[1]["content"], F.lit("<video>")).alias("line"))


@query(f"WITH {SPANS}, v AS (SELECT DISTINCT video_id, level FROM spans), k AS (SELECT video_id, count(*) AS n FROM spans GROUP BY 1), l AS (SELECT v.*, coalesce(n, 0) AS n FROM v LEFT JOIN k ON k.video_id = v.video_id) SELECT video_id, n AS events, CASE WHEN level = 1 THEN n ELSE 0 END AS untimed, CAST(1 AS BIGINT) AS chunks FROM l")
def submission_entries(spark, d):
    """Entries of a submission document, read back from its JSON: events, those without times, the default runtime."""
    s = B.spans(spark, d)
    timed = F.col("level") > 1
    rows = s.select("video_id", F.col("event_id").alias("ord"), "class_name", F.when(timed, F.col("t0")).alias("t0"), F.when(timed, F.col("t1")).alias("t1"), F.lit("").alias("explanation"))
    manifest = B.videos(spark, d).select("video_id", F.col("video_id").alias("manifest_ord"))
    entries = D.submission_entries(rows, manifest)
    kind = "video_id bigint, events array<map<string,string>>, runtime_metadata struct<chunks_processed:bigint>"
    e = entries.select(F.from_json("entry", kind).alias("e"))
    return e.select("e.video_id", F.size("e.events").cast("long").alias("events"), F.size(F.filter("e.events", lambda x: x["start_time_sec"].isNull())).cast("long").alias("untimed"), F.col("e.runtime_metadata.chunks_processed").alias("chunks"))


@query("SELECT event_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 80)) AS share, CASE WHEN value <= 20 THEN 5 WHEN value <= 60 THEN 10 WHEN value <= 300 THEN 30 ELSE 60 END AS step FROM events WHERE value >= 5")
def ruler(spark, d):
    e = B.table(spark, d, "events").where("value >= 5").select("event_id", X.on_scale("value", F.lit(80.0)).alias("share"), X.ticks("value").alias("x"), "value")
    step = F.when(F.size("x") > 1, F.get("x", F.lit(1)))
    return e.select("event_id", "share", F.coalesce(step, F.when(F.col("value") <= 60, 10).when(F.col("value") <= 300, 30).otherwise(60)).alias("step"))


@query("WITH m AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ClientError: 429 on ' || event_type WHEN 1 THEN 'Too Many Requests' WHEN 2 THEN 'read timed out' WHEN 3 THEN 'Timeout' WHEN 4 THEN '' ELSE event_type END AS t FROM events) SELECT event_id, CASE WHEN t LIKE '%429%' OR lower(t) LIKE '%too many requests%' THEN 'rate limit' WHEN lower(t) LIKE '%timeout%' OR lower(t) LIKE '%timed out%' THEN 'timeout' WHEN t = '' THEN 'none' ELSE 'other' END AS kind FROM m")
def error_kinds(spark, d):
    e = B.table(spark, d, "events")
    k, t = F.col("event_id") % 6, F.col("event_type")
    m = F.when(k == 0, F.concat(F.lit("ClientError: 429 on "), t)).when(k == 1, "Too Many Requests").when(k == 2, "read timed out").when(k == 3, "Timeout").when(k == 4, "").otherwise(t)
    return e.select("event_id", X.error_kind(m).alias("kind"))


@query("SELECT row_number() OVER (ORDER BY user_id) AS ord, user_id AS video_id, CASE WHEN user_id % 2 = 0 THEN 'out/r' || user_id || '.windows.jsonl' END AS sibling FROM (SELECT DISTINCT user_id FROM events)")
def sibling_paths(spark, d):
    v = B.table(spark, d, "events").select("user_id").distinct()
    path = F.concat(F.lit("out/r"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 2 == 0, ".events.jsonl").otherwise(".json"))
    return v.select(F.row_number().over(Window.orderBy("user_id")).cast("long").alias("ord"), F.col("user_id").alias("video_id"), X.sibling(path).alias("sibling"))


@query(f"WITH {HOURLY}, {Z} SELECT video_id, count(*) AS seconds, count(*) FILTER (label) AS in_event_seconds, count(*) FILTER (round(z, 9) > 3) AS spikes FROM z GROUP BY 1")
def motion_report(spark, d):
    """The per-video part of the motion report."""
    z = G.robust_z(B.hourly(spark, d), ["video_id"], "x")
    return z.groupBy("video_id").agg(F.count("*").alias("seconds"), F.count_if("label").alias("in_event_seconds"), F.count_if(F.round("z", 9) > 3).alias("spikes"))

