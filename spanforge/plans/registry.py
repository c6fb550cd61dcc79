"""Every query of the interval and event operators, with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import spans as S
from ..operators import documents as D
from ..operators import islands as I
from ..operators import matching as M
from ..operators import signals as G
from ..operators import timeline as T
from . import tables as B

_queries, _sql = {}, {}

#: Common parts of the SQL.
SPANS = """spans AS (SELECT event_id, user_id AS video_id, CAST(1 + user_id % 3 AS INTEGER) AS level, event_type AS class_name,
 (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9::DOUBLE AS t0, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9::DOUBLE + value AS t1,
 CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS confidence, value FROM events)"""


def merged_sql(name, where, gap, keys="video_id, class_name"):
    return f"""{name}_f AS (SELECT *, CASE WHEN t0 <= max(t1) OVER (PARTITION BY {keys} ORDER BY t0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap}::DOUBLE THEN 0 ELSE 1 END AS b FROM spans WHERE {where}),
 {name}_r AS (SELECT *, sum(b) OVER (PARTITION BY {keys} ORDER BY t0, event_id ROWS UNBOUNDED PRECEDING) AS run FROM {name}_f),
 {name} AS (SELECT {keys}, min(t0) AS t0, max(t1) AS t1, max(confidence) AS confidence, count(*) AS n, min(event_id) AS event_id, arg_max(event_id, (confidence, -event_id)) AS best FROM {name}_r GROUP BY {keys}, run)"""


def query(sql=None):
    def put(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return put


IOU = "(CASE WHEN least(g.t1, p.t1) - greatest(g.t0, p.t0) <= 0 THEN 0.0::DOUBLE ELSE (least(g.t1, p.t1) - greatest(g.t0, p.t0)) / ((g.t1 - g.t0) + (p.t1 - p.t0) - (least(g.t1, p.t1) - greatest(g.t0, p.t0))) END)"
TRUTH_RAW = "g AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY class_name, t0, event_id) - 1 AS gi FROM spans WHERE event_id % 2 = 0), p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY class_name, t0, event_id) - 1 AS pi FROM spans WHERE event_id % 2 = 1)"


@query(f"WITH {SPANS} SELECT event_id, video_id, level, class_name, t0, t1, confidence, t1 - t0 AS length FROM spans")
def span_projection(spark, d):
    return B.spans(spark, d).select("event_id", "video_id", "level", "class_name", "t0", "t1", "confidence", (F.col("t1") - F.col("t0")).alias("length"))


@query(f"""WITH {SPANS}, r AS (SELECT *, CASE WHEN class_name NOT IN ('click', 'view', 'purchase', 'signup') THEN 'unknown class' WHEN t1 - 5 <= t0 THEN 'ends before it starts' END AS reason FROM spans)
SELECT level, coalesce(reason, 'ok') AS reason, count(*) AS n FROM r GROUP BY 1, 2""")
def span_validity_report(spark, d):
    s = B.spans(spark, d).withColumn("reason", S.problem("class_name", "t0", F.col("t1") - 5, B.CLASSES[:4]))
    return s.groupBy("level", F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {SPANS}, {TRUTH_RAW} SELECT g.video_id, g.class_name, g.event_id AS g_id, p.event_id AS p_id, {IOU} AS iou
FROM g JOIN p ON g.video_id = p.video_id AND g.class_name = p.class_name AND g.t0 < p.t1 AND p.t0 < g.t1 WHERE {IOU} >= 0.5""")
def iou_pairs(spark, d):
    g, p = B.truth(spark, d).withColumn("gi", F.col("event_id")), B.predictions(spark, d).withColumn("pi", F.col("event_id"))
    return M.candidates(g, p, 0.5).drop("island").withColumnsRenamed({"gi": "g_id", "pi": "p_id"})


@query(f"""WITH {SPANS}, {TRUTH_RAW} SELECT g.video_id, g.class_name, g.event_id AS g_id, p.event_id AS p_id, {IOU} AS iou
FROM g JOIN p ON g.video_id = p.video_id AND g.class_name = p.class_name WHERE abs(g.t0 - p.t0) <= 15 AND abs(g.t1 - p.t1) <= 15""")
def tolerance_pairs(spark, d):
    g, p = B.truth(spark, d).withColumn("gi", F.col("event_id")), B.predictions(spark, d).withColumn("pi", F.col("event_id"))
    return M.candidates(g, p, tolerance=15.0).drop("island").withColumnsRenamed({"gi": "g_id", "pi": "p_id"})


EXISTS = "EXISTS (SELECT 1 FROM p WHERE g.video_id = p.video_id AND g.class_name = p.class_name AND g.t0 < p.t1 AND p.t0 < g.t1)"


def overlapping(spark, d, how):
    g, p = B.truth(spark, d).alias("g"), B.predictions(spark, d).alias("p")
    on = (F.col("g.video_id") == F.col("p.video_id")) & (F.col("g.class_name") == F.col("p.class_name")) & (F.col("g.t0") < F.col("p.t1")) & (F.col("p.t0") < F.col("g.t1"))
    return g.join(p, on, how).select("event_id", "video_id", "class_name")


@query(f"WITH {SPANS}, {TRUTH_RAW} SELECT event_id, video_id, class_name FROM g WHERE {EXISTS}")
def overlap_semi(spark, d):
    return overlapping(spark, d, "left_semi")


@query(f"WITH {SPANS}, {TRUTH_RAW} SELECT event_id, video_id, class_name FROM g WHERE NOT {EXISTS}")
def overlap_anti(spark, d):
    return overlapping(spark, d, "left_anti")


@query(f"""WITH {SPANS}, {TRUTH_RAW} SELECT g.video_id, g.event_id AS g_id, p.event_id AS p_id, least(g.t1, p.t1) - greatest(g.t0, p.t0) AS seconds
FROM g JOIN p ON g.video_id = p.video_id AND g.t0 < p.t1 AND p.t0 < g.t1""")
def binned_interval_join(spark, d):
    a = B.truth(spark, d).select("video_id", F.col("event_id").alias("g_id"), F.col("t0").alias("a0"), F.col("t1").alias("a1"))
    b = B.predictions(spark, d).select("video_id", F.col("event_id").alias("p_id"), F.col("t0").alias("b0"), F.col("t1").alias("b1"))
    return M.interval_join(a, b, ["video_id"], 48.0).select("video_id", "g_id", "p_id", (F.least("a1", "b1") - F.greatest("a0", "b0")).alias("seconds"))


@query(f"WITH {SPANS}, {merged_sql('m', 'true', 6)} SELECT video_id, class_name, t0, t1, confidence, n FROM m")
def merge_events(spark, d):
    return I.coalesce_spans(B.spans(spark, d), ["video_id", "class_name"], 6.0)


@query(f"WITH {SPANS}, {merged_sql('m', '''confidence >= greatest(0.2, CASE class_name WHEN 'error' THEN 0.5 WHEN 'view' THEN 0.1 ELSE 0 END)''', 6)} SELECT video_id, class_name, t0, t1, confidence, n FROM m")
def merge_events_per_class_conf(spark, d):
    s = B.spans(spark, d).where(S.confident("confidence", 0.2, {"error": 0.5, "view": 0.1}))
    return I.coalesce_spans(s, ["video_id", "class_name"], 6.0)


PADDED = "padded AS (SELECT video_id, class_name, greatest(0.0, t0 - 2) AS t0, least(720.0, t1 + 2) AS t1, confidence, n, event_id FROM m WHERE least(720.0, t1 + 2) - greatest(0.0, t0 - 2) >= 8)"


def padded(spark, d):
    m = I.coalesce_spans(B.spans(spark, d), ["video_id", "class_name"], 6.0, extra={"event_id": F.min("event_id")})
    m = m.withColumn("t0", F.greatest(F.lit(0.0), F.col("t0") - 2)).withColumn("t1", F.least(F.lit(B.DURATION), F.col("t1") + 2))
    return m.where(F.col("t1") - F.col("t0") >= 8)


@query(f"WITH {SPANS}, {merged_sql('m', 'true', 6)}, {PADDED} SELECT video_id, class_name, t0::DOUBLE AS t0, t1::DOUBLE AS t1, confidence, n FROM padded")
def merge_pad_clamp(spark, d):
    return padded(spark, d).drop("event_id")


@query(f"""WITH {SPANS}, {merged_sql('m', 'true', 6)}, {PADDED}, k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, class_name, t0) AS rank FROM padded)
SELECT video_id, class_name, t0::DOUBLE AS t0, t1::DOUBLE AS t1, confidence, rank FROM k WHERE rank <= 12""")
def merge_topk(spark, d):
    k = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("confidence"), "class_name", "t0"))
    return padded(spark, d).withColumn("rank", k.cast("long")).where("rank <= 12").select("video_id", "class_name", "t0", "t1", "confidence", "rank")


@query(f"WITH {SPANS}, {merged_sql('m', 'true', 6)} SELECT video_id, class_name, t0, t1, best FROM m")
def merge_best_explanation(spark, d):
    m = I.coalesce_spans(B.spans(spark, d), ["video_id", "class_name"], 6.0, extra={"best": I.first_best("event_id")})
    return m.select("video_id", "class_name", "t0", "t1", "best")


@query(f"""WITH {SPANS}, f AS (SELECT *, CASE WHEN lag(class_name) OVER w = class_name AND t0 - lag(t1) OVER w < 0.75 THEN 0 ELSE 1 END AS b FROM spans WINDOW w AS (PARTITION BY video_id ORDER BY t0, event_id)),
r AS (SELECT *, sum(b) OVER (PARTITION BY video_id ORDER BY t0, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f),
o AS (SELECT video_id, class_name, min(t0) AS t0, arg_max(t1, (t0, event_id)) AS t1, count(*) AS n FROM r GROUP BY video_id, run, class_name)
SELECT * FROM o WHERE t1 - t0 > 0.5""")
def consecutive_merge(spark, d):
    return I.merge_consecutive(B.spans(spark, d), ["video_id"], "class_name", 0.75, 0.5)


@query(f"""WITH {SPANS}, f AS (SELECT video_id, event_id, t0, value > 30 AS flag, lag(value > 30) OVER (PARTITION BY video_id ORDER BY t0, event_id) AS before FROM spans),
r AS (SELECT *, sum(CASE WHEN NOT flag OR NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY t0, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT video_id, min(t0) AS t0, max(t0) AS t1, count(*) AS n FROM r WHERE flag GROUP BY video_id, run HAVING max(t0) - min(t0) >= 6""")
def sustained_runs(spark, d):
    s = B.spans(spark, d).select("video_id", "event_id", F.col("t0").alias("t"), "value")
    return I.sustained_runs(s, ["video_id"], "t", F.col("value") > 30, 6.0, ["t", "event_id"])


@query(f"""WITH {SPANS}, f AS (SELECT video_id, event_id, t0, CASE WHEN t0 - lag(t0) OVER (PARTITION BY video_id ORDER BY t0, event_id) <= 2 THEN 0 ELSE 1 END AS b FROM spans WHERE value > 60),
r AS (SELECT *, sum(b) OVER (PARTITION BY video_id ORDER BY t0, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT video_id, min(t0) AS at, count(*) AS n FROM r GROUP BY video_id, run""")
def spike_groups(spark, d):
    return I.spike_groups(B.spans(spark, d).where("value > 60").withColumnRenamed("t0", "t"), ["video_id"], "t", 2.0, ["t", "event_id"])


# matching of merged truth and predictions

MERGED = f"""{SPANS}, {merged_sql('gm', 'event_id % 2 = 0', 6)}, {merged_sql('pm', 'event_id % 2 = 1', 6)},
g AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY class_name, t0, event_id) - 1 AS gi FROM gm),
p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY class_name, t0, event_id) - 1 AS pi FROM pm)"""
CANDIDATES = f"c0 AS (SELECT g.video_id, g.class_name, gi, pi, {IOU} AS iou FROM g JOIN p ON g.video_id = p.video_id AND g.class_name = p.class_name AND g.t0 < p.t1 AND p.t0 < g.t1 WHERE {IOU} >= 0.3), c AS (SELECT *, row_number() OVER (PARTITION BY video_id, class_name ORDER BY iou DESC, gi, pi) AS rn FROM c0)"
GREEDY = """r(video_id, class_name, rn, gs, ps, took, gi, pi, iou) AS (
 SELECT video_id, class_name, rn, [gi], [pi], true, gi, pi, iou FROM c WHERE rn = 1
 UNION ALL
 SELECT c.video_id, c.class_name, c.rn, CASE WHEN list_contains(r.gs, c.gi) OR list_contains(r.ps, c.pi) THEN r.gs ELSE list_append(r.gs, c.gi) END,
  CASE WHEN list_contains(r.gs, c.gi) OR list_contains(r.ps, c.pi) THEN r.ps ELSE list_append(r.ps, c.pi) END,
  NOT (list_contains(r.gs, c.gi) OR list_contains(r.ps, c.pi)), c.gi, c.pi, c.iou
 FROM r JOIN c ON c.video_id = r.video_id AND c.class_name = r.class_name AND c.rn = r.rn + 1),
 m AS (SELECT video_id, class_name, gi, pi, iou FROM r WHERE took)"""
MATCHED = f"WITH RECURSIVE {MERGED}, {CANDIDATES}, {GREEDY}"
VERDICTS = """v AS (SELECT g.video_id, g.class_name, CASE WHEN m.gi IS NULL THEN 'miss' ELSE 'hit' END AS verdict FROM g LEFT JOIN m ON g.video_id = m.video_id AND g.gi = m.gi
 UNION ALL SELECT p.video_id, p.class_name, 'false_alarm' FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.video_id = p.video_id AND m.pi = p.pi))"""
TALLY = "count(*) FILTER (verdict = 'hit') AS tp, count(*) FILTER (verdict = 'false_alarm') AS fa, count(*) FILTER (verdict = 'miss') AS miss"


def matched(spark, d, threshold=0.3):
    """Merged truth and predictions with their places, and the matches."""
    sides = []
    for rows, name in ((B.truth(spark, d), "gi"), (B.predictions(spark, d), "pi")):
        m = I.coalesce_spans(rows, ["video_id", "class_name"], 6.0, extra={"event_id": F.min("event_id")})
        sides.append(M.indexed(m, name))
    return (*sides, M.greedy_match(M.candidates(*sides, threshold)))


@query(f"{MATCHED} SELECT video_id, class_name, CAST(gi AS INTEGER) AS gi, CAST(pi AS INTEGER) AS pi, iou FROM m")
def greedy_match(spark, d):
    return matched(spark, d)[2]


@query(f"{MATCHED} SELECT g.video_id, g.class_name, g.t0, g.t1 FROM g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.video_id = g.video_id AND m.gi = g.gi)")
def match_misses(spark, d):
    g, _, m = matched(spark, d)
    return g.join(m.select("video_id", "gi"), ["video_id", "gi"], "left_anti").select("video_id", "class_name", "t0", "t1")


@query(f"{MATCHED} SELECT p.video_id, p.class_name, p.t0, p.t1 FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.video_id = p.video_id AND m.pi = p.pi)")
def match_false_alarms(spark, d):
    _, p, m = matched(spark, d)
    return p.join(m.select("video_id", "pi"), ["video_id", "pi"], "left_anti").select("video_id", "class_name", "t0", "t1")


RATES = """CASE WHEN tp + fa = 0 THEN 1 ELSE tp / (tp + fa)::DOUBLE END::DOUBLE AS precision, CASE WHEN tp + miss = 0 THEN 1 ELSE tp / (tp + miss)::DOUBLE END::DOUBLE AS recall"""
F1 = "CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1"
LEVELS = "lv(level, marks) AS (VALUES (1, 25.0::DOUBLE), (2, 35.0::DOUBLE), (3, 40.0::DOUBLE))"
BY_LEVEL = f"{LEVELS}, t AS (SELECT CAST(1 + video_id % 3 AS INTEGER) AS level, {TALLY} FROM v GROUP BY 1), l AS (SELECT lv.level, marks, coalesce(tp, 0) AS tp, coalesce(fa, 0) AS fa, coalesce(miss, 0) AS miss FROM lv LEFT JOIN t ON lv.level = t.level), rt AS (SELECT *, {RATES} FROM l), s AS (SELECT *, {F1} FROM rt)"


def verdicts(spark, d):
    return M.verdicts(*matched(spark, d))


@query(f"{MATCHED}, {VERDICTS}, t AS (SELECT class_name, {TALLY} FROM v GROUP BY 1), rt AS (SELECT *, {RATES} FROM t) SELECT *, {F1} FROM rt")
def score_by_class(spark, d):
    return M.rated(M.tally(verdicts(spark, d), "class_name"))


@query(f"{MATCHED}, {VERDICTS}, {BY_LEVEL} SELECT * FROM s")
def score_by_level(spark, d):
    return M.rated(M.by_level(verdicts(spark, d), B.videos(spark, d)))


@query(f"{MATCHED}, {VERDICTS}, t AS (SELECT {TALLY} FROM v), rt AS (SELECT *, {RATES} FROM t) SELECT *, {F1} FROM rt")
def score_overall(spark, d):
    return M.rated(M.tally(verdicts(spark, d)))


@query(f"{MATCHED}, {VERDICTS}, {BY_LEVEL} SELECT round(sum(marks * f1), 6) AS score FROM s")
def proxy_score(spark, d):
    return score_by_level(spark, d).agg(F.round(F.sum(F.col("marks") * F.col("f1")), 6).alias("score"))


CREDITS = {
    "credit_f1": (S.credit_f1, "CASE WHEN tp = 0 THEN CASE WHEN fa = 0 AND miss = 0 THEN 1 ELSE 0 END::DOUBLE ELSE 2.0::DOUBLE * tp / (2 * tp + fa + miss) END"),
    "credit_exact": (S.credit_exact, "CASE WHEN fa = 0 AND miss = 0 THEN 1 ELSE 0 END::DOUBLE"),
    "credit_recall": (S.credit_recall, "CASE WHEN tp + miss = 0 THEN CASE WHEN fa = 0 THEN 1 ELSE 0 END::DOUBLE ELSE tp / (tp + miss)::DOUBLE END"),
}
VIDEO_TALLY = f"t0_ AS (SELECT video_id, {TALLY} FROM v GROUP BY 1), t AS (SELECT u.video_id, CAST(1 + u.video_id % 3 AS INTEGER) AS level, coalesce(tp, 0) AS tp, coalesce(fa, 0) AS fa, coalesce(miss, 0) AS miss FROM (SELECT DISTINCT user_id AS video_id FROM events) u LEFT JOIN t0_ ON u.video_id = t0_.video_id)"


def _credit(name, credit, sql):
    def f(spark, d):
        out = M.per_video_credit(verdicts(spark, d), B.videos(spark, d), credit)
        return out.select("level", "videos", F.round("mean_credit", 6).alias("mean_credit"), F.round("marks", 6).alias("marks"))

    f.__name__ = name
    query(f"{MATCHED}, {VERDICTS}, {VIDEO_TALLY}, {LEVELS} SELECT t.level, count(*) AS videos, round(avg({sql}), 6) AS mean_credit, round(avg({sql}) * any_value(marks), 6) AS marks FROM t JOIN lv ON lv.level = t.level GROUP BY t.level")(f)


for _name, (_f, _s) in CREDITS.items():
    _credit(_name, _f, _s)


@query(f"{MATCHED}, {VERDICTS}, {VIDEO_TALLY}, {LEVELS}, c2 AS (SELECT level, avg({CREDITS['credit_f1'][1]}) AS mc, count(*) AS videos FROM t GROUP BY level) SELECT c2.level, videos, marks AS most, round(mc * marks, 6) AS marks, round(marks / videos, 6) AS per_video FROM c2 JOIN lv ON lv.level = c2.level")
def marks_by_level(spark, d):
    t = M.per_video_credit(verdicts(spark, d), B.videos(spark, d), S.credit_f1)
    lv = M.levels(spark).withColumnRenamed("marks", "most")
    return t.join(lv, "level").select("level", "videos", "most", F.round("marks", 6).alias("marks"), F.round(F.col("most") / F.col("videos"), 6).alias("per_video"))


STATES = "st AS (SELECT video_id, CASE WHEN video_id % 11 = 0 THEN 'not_run' WHEN video_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS state FROM (SELECT DISTINCT user_id AS video_id FROM events))"


def states(spark, d):
    """Whether a video was run: by its number here, as no table tells."""
    v = F.col("video_id")
    return B.videos(spark, d).withColumn("state", F.when(v % 11 == 0, "not_run").when(v % 7 == 0, "failed").otherwise("ok"))


@query(f"{MATCHED}, {VERDICTS}, {STATES} SELECT st.video_id, state, count(v.verdict) FILTER (state = 'ok') AS verdicts, count(*) FILTER (state = 'ok' AND v.verdict = 'hit') AS hits FROM st LEFT JOIN v ON v.video_id = st.video_id GROUP BY 1, 2")
def review_three_state(spark, d):
    j = states(spark, d).join(verdicts(spark, d).select("video_id", "verdict"), "video_id", "left")
    ok = F.col("state") == "ok"
    return j.groupBy("video_id", "state").agg(F.count(F.when(ok, F.col("verdict"))).alias("verdicts"), F.count_if(ok & (F.col("verdict") == "hit")).alias("hits"))


@query(f"""{MATCHED}, {VERDICTS}, {STATES}, {LEVELS}, a AS (SELECT CAST(1 + st.video_id % 3 AS INTEGER) AS level, {TALLY} FROM v JOIN st ON st.video_id = v.video_id WHERE state = 'ok' GROUP BY 1),
b AS (SELECT CAST(1 + video_id % 3 AS INTEGER) AS level, count(*) FILTER (state = 'ok') AS videos_scored, count(*) AS videos_total FROM st GROUP BY 1)
SELECT lv.level, coalesce(videos_scored, 0) AS videos_scored, coalesce(videos_total, 0) AS videos_total, tp, fa, miss, tp / nullif(tp + fa, 0)::DOUBLE AS precision, tp / nullif(tp + miss, 0)::DOUBLE AS recall FROM lv LEFT JOIN a ON a.level = lv.level LEFT JOIN b ON b.level = lv.level""")
def level_summary_ok_only(spark, d):
    st = states(spark, d)
    a = M.tally(verdicts(spark, d).join(st.where("state = 'ok'"), "video_id"), "level")
    b = st.groupBy("level").agg(F.count_if(F.col("state") == "ok").alias("videos_scored"), F.count("*").alias("videos_total"))
    out = M.levels(spark).drop("marks").join(a, "level", "left").join(b, "level", "left").na.fill(0, ["videos_scored", "videos_total"])
    return out.withColumn("precision", S.precision("tp", "fa", None)).withColumn("recall", S.recall("tp", "miss", None))


# windows and look-ups


def planned(spark, d, win, hop, single):
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("video_id"), (F.col("o_orderkey") % 97 + 1).cast("double").alias("duration"))
    return o.select("video_id", F.explode(T.plan_windows("duration", win, hop, single)).alias("w")).select("video_id", F.col("w.t0").alias("w0"), F.col("w.t1").alias("w1"))


def plan_sql(win, hop, single):
    return f"""WITH o AS (SELECT o_orderkey AS video_id, (o_orderkey % 97 + 1)::DOUBLE AS d FROM orders),
 k AS (SELECT video_id, d, unnest(range(CASE WHEN d <= {single} THEN 1 ELSE least(ceil(d / {hop}), greatest(1, ceil((d - {win}) / {hop}) + 1))::BIGINT END)) AS i FROM o)
 SELECT video_id, (i * {hop})::DOUBLE AS w0, CASE WHEN d <= {single} THEN d ELSE least(i * {hop} + {win}, d) END::DOUBLE AS w1 FROM k"""


@query(plan_sql(20, 10, 30))
def plan_windows_sliding(spark, d):
    return planned(spark, d, 20.0, 10.0, 30.0)


@query(plan_sql(20, 20, 20))
def plan_windows_tumbling(spark, d):
    return planned(spark, d, 20.0, 20.0, 20.0)


@query(plan_sql(20, 10, 1000))
def plan_windows_single(spark, d):
    return planned(spark, d, 20.0, 10.0, 1000.0)


WINDOWS = "win AS (SELECT video_id, (i * 20)::DOUBLE AS w0, (i * 20 + 20)::DOUBLE AS w1 FROM (SELECT DISTINCT user_id AS video_id FROM events), range(36) t(i))"
CLIPPED = f"""WITH {SPANS}, {WINDOWS}, cl AS (SELECT w.video_id, w.w0, w.w1, s.class_name, greatest(s.t0, w.w0) - w.w0 AS r0, least(s.t1, w.w1) - w.w0 AS r1 FROM win w LEFT JOIN spans s ON s.video_id = w.video_id AND s.t0 < w.w1 AND w.w0 < s.t1 AND least(s.t1, w.w1) - greatest(s.t0, w.w0) >= 0.5)"""


def windows_of(spark, d):
    w = F.explode(T.plan_windows(F.lit(B.DURATION), 20.0, 20.0, 20.0))
    return B.videos(spark, d).select("video_id", w.alias("w")).select("video_id", F.col("w.t0").alias("w0"), F.col("w.t1").alias("w1"))


@query(f"{CLIPPED} SELECT video_id, w0, w1, class_name, CASE WHEN class_name IS NOT NULL THEN r0 END AS r0, CASE WHEN class_name IS NOT NULL THEN r1 END AS r1 FROM cl")
def clip_events_to_windows(spark, d):
    return T.clip_to_windows(windows_of(spark, d), B.spans(spark, d))


@query(f"{CLIPPED}, n AS (SELECT video_id, w0, count(class_name) AS k FROM cl GROUP BY 1, 2) SELECT count(*) AS windows, count(*) FILTER (k = 0) AS negatives, (count(*) FILTER (k = 0)) / count(*)::DOUBLE AS share FROM n")
def negatives_share(spark, d):
    n = clip_events_to_windows(spark, d).groupBy("video_id", "w0").agg(F.count("class_name").alias("k"))
    return n.agg(F.count("*").alias("windows"), F.count_if(F.col("k") == 0).alias("negatives"), (F.count_if(F.col("k") == 0) / F.count("*")).alias("share"))


@query(f"WITH {SPANS}, m AS (SELECT video_id, t0 AS mark FROM spans WHERE class_name = 'error'), p AS (SELECT * FROM spans WHERE class_name <> 'error') SELECT p.event_id, p.video_id, m.mark FROM p ASOF LEFT JOIN m ON p.video_id = m.video_id AND p.t0 >= m.mark")
def asof_window_backward(spark, d):
    s = B.spans(spark, d)
    marks = s.where("class_name = 'error'").select("video_id", F.col("t0").alias("mark"))
    return T.as_of(s.where("class_name <> 'error'").select("event_id", "video_id", "t0"), marks, "video_id", "t0", "mark").select("event_id", "video_id", "mark")


@query(f"WITH {SPANS}, m AS (SELECT video_id, t0 AS mark FROM spans WHERE class_name = 'error'), p AS (SELECT event_id, video_id, t0 + 0.2::DOUBLE AS t FROM spans WHERE class_name <> 'error') SELECT p.event_id, p.video_id, m.mark FROM p ASOF LEFT JOIN m ON p.video_id = m.video_id AND p.t <= m.mark")
def next_marker_forward(spark, d):
    s = B.spans(spark, d)
    marks = s.where("class_name = 'error'").select("video_id", F.col("t0").alias("mark"))
    p = s.where("class_name <> 'error'").select("event_id", "video_id", (F.col("t0") + 0.2).alias("t"))
    return T.as_of(p, marks, "video_id", "t", "mark", forward=True).select("event_id", "video_id", "mark")


def queries():
    from . import extra, more  # noqa: F401

    return dict(_queries)


def oracle_sql():
    from . import extra, more  # noqa: F401

    return dict(_sql)
