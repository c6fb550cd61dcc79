"""Queries on sweeps, consensus, latency, parsing, documents, tracks, series and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import spans as S
from ..operators import documents as D
from ..operators import islands as I
from ..operators import matching as M
from ..operators import signals as G
from ..operators import sweep as W
from ..operators import timeline as T
from ..operators import tracks as R
from . import tables as B
from .registry import CANDIDATES, F1, GREEDY, IOU, MERGED, RATES, SPANS, _sql, merged_sql, query  # noqa: F401

CONSENSUS = f"""WITH RECURSIVE {SPANS}, o AS (SELECT video_id, class_name, event_id % 3 AS run, t0, t1, confidence, row_number() OVER (PARTITION BY video_id, class_name ORDER BY t0, t1, event_id) AS rn FROM spans),
r(video_id, class_name, rn, seeds, seed) AS (
 SELECT video_id, class_name, rn, [{{'a': t0, 'b': t1, 'k': rn}}], rn FROM o WHERE rn = 1
 UNION ALL
 SELECT video_id, class_name, rn, CASE WHEN hit IS NULL THEN list_append(seeds, {{'a': t0, 'b': t1, 'k': rn}}) ELSE seeds END, coalesce(hit, rn)
 FROM (SELECT o.video_id, o.class_name, o.rn, o.t0, o.t1, r.seeds, list_filter(r.seeds, lambda s: greatest(s.b - s.a, o.t1 - o.t0) > 0 AND greatest(0.0, least(s.b, o.t1) - greatest(s.a, o.t0)) >= 0.1::DOUBLE * greatest(s.b - s.a, o.t1 - o.t0))[1].k AS hit
  FROM r JOIN o ON o.video_id = r.video_id AND o.class_name = r.class_name AND o.rn = r.rn + 1))
SELECT r.video_id, r.class_name, min(o.t0) AS t0, least(720.0::DOUBLE, max(o.t1)) AS t1, max(confidence) AS confidence, CAST(count(DISTINCT o.run) AS INTEGER) AS n_agree
FROM r JOIN o ON o.video_id = r.video_id AND o.class_name = r.class_name AND o.rn = r.rn GROUP BY r.video_id, r.class_name, r.seed HAVING count(DISTINCT o.run) >= 2"""


@query(CONSENSUS)
def consensus_k2(spark, d):
    return M.consensus(B.spans(spark, d).withColumn("run", F.col("event_id") % 3), B.DURATION)


SWEEP_GRID = """grid AS (SELECT CAST(row_number() OVER (ORDER BY a.i, b.i, c.i) - 1 AS INTEGER) AS grid_ord, a.v::DOUBLE AS min_conf, b.v::DOUBLE AS gap_tol, c.v::DOUBLE AS min_dur
 FROM (VALUES (0, 0.0), (1, 0.25), (2, 0.35), (3, 0.5), (4, 0.65), (5, 0.8)) a(i, v), (VALUES (0, 0.0), (1, 3.0), (2, 6.0), (3, 12.0)) b(i, v), (VALUES (0, 0.0), (1, 1.0), (2, 3.0)) c(i, v))"""
SWEEP = f"""WITH RECURSIVE {SPANS}, {SWEEP_GRID}, gt AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY class_name, t0, event_id) - 1 AS gi FROM spans WHERE event_id % 2 = 0),
k AS (SELECT grid_ord, gap_tol, min_dur, video_id, class_name, event_id, t0, t1 + gap_tol AS t1 FROM spans JOIN grid ON confidence >= min_conf WHERE event_id % 2 = 1),
kf AS (SELECT *, CASE WHEN t0 <= max(t1) OVER (PARTITION BY grid_ord, video_id, class_name ORDER BY t0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS b FROM k),
kr AS (SELECT *, sum(b) OVER (PARTITION BY grid_ord, video_id, class_name ORDER BY t0, event_id ROWS UNBOUNDED PRECEDING) AS run FROM kf),
km AS (SELECT grid_ord, video_id, class_name, min(t0) AS t0, max(t1) - any_value(gap_tol) AS t1, min(event_id) AS event_id, any_value(min_dur) AS min_dur FROM kr GROUP BY grid_ord, video_id, class_name, run),
pp AS (SELECT *, row_number() OVER (PARTITION BY grid_ord, video_id ORDER BY class_name, t0, event_id) - 1 AS pi FROM km WHERE t1 - t0 >= min_dur),
c0 AS (SELECT p.grid_ord, g.video_id, g.class_name, gi, pi, {IOU} AS iou FROM gt g JOIN pp p ON g.video_id = p.video_id AND g.class_name = p.class_name AND g.t0 < p.t1 AND p.t0 < g.t1 WHERE {IOU} >= 0.3),
c AS (SELECT *, row_number() OVER (PARTITION BY grid_ord, video_id, class_name ORDER BY iou DESC, gi, pi) AS rn FROM c0),
r(grid_ord, video_id, class_name, rn, gs, ps, took) AS (SELECT grid_ord, video_id, class_name, rn, [gi], [pi], true FROM c WHERE rn = 1 UNION ALL
 SELECT c.grid_ord, c.video_id, c.class_name, c.rn, CASE WHEN list_contains(r.gs, c.gi) OR list_contains(r.ps, c.pi) THEN r.gs ELSE list_append(r.gs, c.gi) END,
  CASE WHEN list_contains(r.gs, c.gi) OR list_contains(r.ps, c.pi) THEN r.ps ELSE list_append(r.ps, c.pi) END, NOT (list_contains(r.gs, c.gi) OR list_contains(r.ps, c.pi))
 FROM r JOIN c ON c.grid_ord = r.grid_ord AND c.video_id = r.video_id AND c.class_name = r.class_name AND c.rn = r.rn + 1),
n AS (SELECT grid_ord, count(*) AS n FROM pp GROUP BY 1), h AS (SELECT grid_ord, count(*) AS tp FROM r WHERE took GROUP BY 1),
t AS (SELECT grid.*, coalesce(tp, 0) AS tp, coalesce(n.n, 0) - coalesce(tp, 0) AS fa, (SELECT count(*) FROM gt) - coalesce(tp, 0) AS miss FROM grid LEFT JOIN n ON n.grid_ord = grid.grid_ord LEFT JOIN h ON h.grid_ord = grid.grid_ord),
rt AS (SELECT *, {RATES} FROM t), sc AS (SELECT grid_ord, min_conf, gap_tol, min_dur, tp, fa, miss, {F1} FROM rt)"""


@query(f"{SWEEP} SELECT * FROM sc")
def sweep_grid_72(spark, d):
    configs = W.grid(spark)
    t = W.sweep(B.truth(spark, d), B.predictions(spark, d), configs, 0.3)
    return configs.join(t, "grid_ord").withColumn("f1", S.f1("tp", "fa", "miss"))


@query(f"{SWEEP} SELECT * FROM sc ORDER BY f1 DESC, grid_ord LIMIT 10")
def sweep_best(spark, d):
    """The ten best configurations; the earlier one wins a tie."""
    return sweep_grid_72(spark, d).orderBy(F.desc("f1"), "grid_ord").limit(10)


# latencies


@query("""SELECT event_type AS model, count(*) AS calls, round(sum(value), 4) AS total_ms, round(avg(value), 6) AS mean_ms, max(value) AS max_ms,
list_sort(list(value))[CAST(floor(0.5 * (count(*) - 1)) AS BIGINT) + 1] AS p50_ms, list_sort(list(value))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS p95_ms FROM events GROUP BY 1""")
def latency_profile(spark, d):
    out = G.latency_profile(B.table(spark, d, "events").withColumnRenamed("event_type", "model"), ["model"], "value")
    return out.withColumn("total_ms", F.round("total_ms", 4)).withColumn("mean_ms", F.round("mean_ms", 6))


@query("""WITH v AS (SELECT user_id, count(*) AS n, avg(value) AS mean, max(value) AS worst FROM events GROUP BY 1)
SELECT round(sum(mean * n) / sum(n), 6) AS mean_ms, round(sum(worst * n) / sum(n), 6) AS weighted_max_ms, round(10 * 1000 / (sum(mean * n) / sum(n)), 4) AS realtime FROM v""")
def latency_weighted(spark, d):
    v = B.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("worst"))
    mean = F.sum(F.col("mean") * F.col("n")) / F.sum("n")
    return v.agg(F.round(mean, 6).alias("mean_ms"), F.round(F.sum(F.col("worst") * F.col("n")) / F.sum("n"), 6).alias("weighted_max_ms"), F.round(F.try_divide(F.lit(10 * 1000.0), mean), 4).alias("realtime"))


@query(f"WITH {SPANS}, g AS (SELECT round(t0 - lag(t0) OVER (PARTITION BY video_id ORDER BY t0, event_id), 0)::BIGINT AS hop FROM spans), n AS (SELECT hop, count(*) AS n FROM g WHERE hop IS NOT NULL GROUP BY 1) SELECT hop, n FROM n ORDER BY n DESC, hop LIMIT 1")
def modal_hop(spark, d):
    w = Window.partitionBy("video_id").orderBy("t0", "event_id")
    hops = B.spans(spark, d).select(F.round(F.col("t0") - F.lag("t0").over(w), 0).cast("long").alias("hop")).where("hop IS NOT NULL")
    return hops.groupBy("hop").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hop").limit(1)


# parsing and documents

TEXTS = """tx AS (SELECT event_id, CASE event_id % 9
 WHEN 0 THEN '```json' || chr(10) || '{"events":[{"class_name":"' || event_type || '","start":1.5,"end":9,"confidence":0.7}]}' || chr(10) || '```'
 WHEN 1 THEN 'Sure: {"events":[{"class_name":" ' || event_type || ' ","start":"2.5","end":0}]} ok'
 WHEN 2 THEN '[]' WHEN 3 THEN '{"events":[{"class_name":"' || event_type || '"' WHEN 4 THEN '' WHEN 5 THEN '{"events":"none"}'
 WHEN 6 THEN '{"events":[3,{"class_name":"other","start":1,"end":2},{"class_name":"' || event_type || '","start":12,"end":8,"confidence":1.7}]}'
 WHEN 7 THEN '{"events":[{"class_name":"' || event_type || '","start":"x","end":3,"explanation":"why not"}]}'
 ELSE '{"events":[{"class_name":"' || event_type || '","start":-4,"end":99,"confidence":-1}]}' END AS text FROM events)"""


def answers(spark, d):
    e = B.table(spark, d, "events")
    t, k = F.col("event_type"), F.col("event_id") % 9
    forms = [
        F.concat(F.lit('```json\n{"events":[{"class_name":"'), t, F.lit('","start":1.5,"end":9,"confidence":0.7}]}\n```')),
        F.concat(F.lit('Sure: {"events":[{"class_name":" '), t, F.lit(' ","start":"2.5","end":0}]} ok')),
        F.lit("[]"),
        F.concat(F.lit('{"events":[{"class_name":"'), t, F.lit('"')),
        F.lit(""),
        F.lit('{"events":"none"}'),
        F.concat(F.lit('{"events":[3,{"class_name":"other","start":1,"end":2},{"class_name":"'), t, F.lit('","start":12,"end":8,"confidence":1.7}]}')),
        F.concat(F.lit('{"events":[{"class_name":"'), t, F.lit('","start":"x","end":3,"explanation":"why not"}]}')),
    ]
    text = F.concat(F.lit('{"events":[{"class_name":"'), t, F.lit('","start":-4,"end":99,"confidence":-1}]}'))
    for i, f in reversed(list(enumerate(forms))):
        text = F.when(k == i, f).otherwise(text)
    return e.select("event_id", text.alias("text"))


BODY = r"b AS (SELECT event_id, text, nullif(regexp_extract(text, '\{.*\}', 0, 's'), '') AS body FROM tx), j AS (SELECT event_id, text, CASE WHEN json_valid(body) THEN body::JSON END AS body FROM b)"


@query(f"""WITH {TEXTS}, {BODY}, e AS (SELECT event_id, unnest(CASE WHEN json_type(body, '$.events') = 'ARRAY' THEN from_json(json_extract(body, '$.events'), '["JSON"]') ELSE [] END) AS e, generate_subscripts(CASE WHEN json_type(body, '$.events') = 'ARRAY' THEN from_json(json_extract(body, '$.events'), '["JSON"]') ELSE [] END, 1) - 1 AS ord FROM j),
f AS (SELECT event_id, ord, trim(e->>'$.class_name') AS class_name, e->>'$.start' AS s, e->>'$.end' AS t, coalesce(try_cast(e->>'$.confidence' AS DOUBLE), 0.5) AS c, coalesce(e->>'$.explanation', '') AS explanation FROM e WHERE json_type(e) = 'OBJECT'),
h AS (SELECT *, (s IS NOT NULL AND try_cast(s AS DOUBLE) IS NULL) OR (t IS NOT NULL AND try_cast(t AS DOUBLE) IS NULL) AS bad FROM f WHERE class_name IN ('click', 'view', 'purchase', 'signup', 'error')),
i AS (SELECT *, greatest(0.0::DOUBLE, least(20.0::DOUBLE, CASE WHEN bad THEN 0 ELSE coalesce(try_cast(s AS DOUBLE), 0) END)) AS t0, greatest(0.0::DOUBLE, least(20.0::DOUBLE, CASE WHEN bad OR coalesce(try_cast(t AS DOUBLE), 0) = 0 THEN 20 ELSE try_cast(t AS DOUBLE) END)) AS t1 FROM h)
SELECT event_id, CAST(ord AS INTEGER) AS ord, class_name, t0, CASE WHEN t1 <= t0 THEN least(20.0::DOUBLE, t0 + 1) ELSE t1 END AS t1, greatest(0.0::DOUBLE, least(c, 1.0::DOUBLE)) AS confidence, explanation FROM i""")
def parse_model_json(spark, d):
    return D.parse_answers(answers(spark, d), ["event_id"], "text", F.lit(20.0), B.CLASSES)


@query(f"WITH {TEXTS}, {BODY} SELECT event_id, CASE WHEN trim(text) = '' THEN 'empty' WHEN body IS NULL THEN 'no json' ELSE 'no events' END AS reason FROM j WHERE body IS NULL OR coalesce(json_type(body, '$.events'), '') <> 'ARRAY'")
def parse_model_json_rejects(spark, d):
    return D.rejects(answers(spark, d), ["event_id"], "text")


SUBMITTED = f"{SPANS}, sv AS (SELECT DISTINCT user_id AS video_id, CAST(1 + user_id % 3 AS INTEGER) AS level, 700.0::DOUBLE AS duration FROM events WHERE user_id % 13 <> 0), sr AS (SELECT s.video_id, s.level, event_id, class_name, t0, t1, confidence, duration, CASE WHEN event_id % 4 = 0 THEN 'short' ELSE ' event number ' || event_id || ' seen here ' END AS x, row_number() OVER (PARTITION BY s.video_id ORDER BY confidence DESC, event_id) AS k FROM spans s JOIN sv ON sv.video_id = s.video_id)"


def submitted(spark, d, gaps=True):
    """Rows and manifest; with gaps, the manifest lacks the videos whose id 13 divides."""
    v = B.videos(spark, d).where("video_id % 13 <> 0" if gaps else "true").withColumn("duration", F.lit(700.0))
    x = F.when(F.col("event_id") % 4 == 0, "short").otherwise(F.concat(F.lit(" event number "), F.col("event_id"), F.lit(" seen here ")))
    return D.submission_events(B.spans(spark, d).drop("level").withColumn("explanation", x), v), v


@query(f"""WITH {SUBMITTED}, c AS (SELECT *, least(greatest(0.0::DOUBLE, t0), greatest(0.0::DOUBLE, duration - 0.5)) AS a, least(t1, duration) AS b FROM sr WHERE level > 1 OR k <= 1)
SELECT video_id, level, event_id, class_name, CASE WHEN level > 1 THEN a END AS t0, CASE WHEN level > 1 THEN CASE WHEN b <= a THEN least(duration, a + 0.5) ELSE b END END AS t1, CASE WHEN length(trim(x)) >= 20 THEN trim(x) END AS explanation FROM c""")
def submission_rows(spark, d):
    return submitted(spark, d)[0]


@query(_sql["submission_rows"].replace(" WHERE user_id % 13 <> 0", ""))
def submission_rows_all_videos(spark, d):
    """As submission_rows, with a manifest of every video."""
    return submitted(spark, d, gaps=False)[0]


@query("""WITH sb AS (SELECT user_id AS video_id, event_id, CASE WHEN user_id % 17 = 0 AND event_id % 2 = 1 THEN 1 ELSE 0 END AS entry, CAST(event_id AS BIGINT) AS ord, event_type AS class_name,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS t0, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value * 2 - event_id % 7 END AS t1, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'brief' ELSE 'long enough to be kept as is' END AS explanation FROM events WHERE user_id % 19 <> 0),
 v AS (SELECT DISTINCT user_id AS video_id, 1 + user_id % 3 AS level, 300.0 AS duration FROM events WHERE user_id % 13 <> 0), k AS (SELECT sb.*, level, duration FROM sb JOIN v ON v.video_id = sb.video_id), f AS (SELECT * FROM k WHERE entry = 0)
SELECT 'unknown id' AS problem, video_id, ord FROM sb WHERE entry = 0 AND NOT EXISTS (SELECT 1 FROM v WHERE v.video_id = sb.video_id)
UNION ALL SELECT 'duplicate id', video_id, ord FROM k WHERE entry > 0
UNION ALL SELECT 'class not in vocabulary', video_id, ord FROM f WHERE class_name NOT IN ('click', 'view', 'purchase', 'signup')
UNION ALL SELECT 'times on level 1', video_id, ord FROM f WHERE level = 1 AND (t0 IS NOT NULL OR t1 IS NOT NULL)
UNION ALL SELECT 'bad times', video_id, ord FROM f WHERE level > 1 AND (t0 IS NULL OR t1 IS NULL OR NOT (0 <= t0 AND t0 < t1 AND t1 <= duration))
UNION ALL SELECT 'explanation length', video_id, ord FROM f WHERE explanation IS NOT NULL AND NOT (length(explanation) BETWEEN 20 AND 500)
UNION ALL SELECT 'missing id', video_id, -1 FROM v WHERE NOT EXISTS (SELECT 1 FROM sb WHERE sb.video_id = v.video_id)""")
def submission_violations(spark, d):
    e = B.table(spark, d, "events").where("user_id % 19 <> 0")
    i, u = F.col("event_id"), F.col("user_id")
    rows = e.select(
        u.alias("video_id"),
        F.when((u % 17 == 0) & (i % 2 == 1), 1).otherwise(0).alias("entry"),
        i.alias("ord"),
        F.col("event_type").alias("class_name"),
        F.when(i % 5 != 0, F.col("value")).alias("t0"),
        F.when(i % 5 != 0, F.col("value") * 2 - i % 7).alias("t1"),
        F.when(i % 3 == 1, "brief").when(i % 3 == 2, "long enough to be kept as is").alias("explanation"),
    )
    v = B.videos(spark, d).where("video_id % 13 <> 0").withColumn("duration", F.lit(300.0))
    return D.violations(rows, v, B.CLASSES[:4])


@query("""WITH c AS (SELECT conv_id, turn, role, text FROM conversations) SELECT conv_id, count(*) AS n, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS messages FROM c GROUP BY 1""")
def sft_messages(spark, d):
    """One conversation per row, its turns in order."""
    c = B.table(spark, d, "conversations")
    line = F.concat("role", F.lit(": "), F.coalesce("text", F.lit("")))
    xs = F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line"))))
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.transform(xs, lambda x: x["line"]), "\n").alias("messages"))


# tracks and series

TRACKS = f"{SPANS}, tr AS (SELECT event_id, video_id, class_name, t0 AS t, value AS x, confidence AS y FROM spans), vel AS (SELECT *, t - lag(t) OVER w AS dt, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM tr WINDOW w AS (PARTITION BY video_id, class_name ORDER BY t, event_id)), ve AS (SELECT event_id, video_id, class_name, t, x, y, dx / dt AS vx, dy / dt AS vy FROM vel WHERE dt > 0)"


def velocities(spark, d):
    return G.velocity(B.tracks(spark, d), ["video_id", "class_name"], "t", "x", "y", ["t", "event_id"])


@query(f"WITH {TRACKS} SELECT * FROM ve")
def track_velocity(spark, d):
    return velocities(spark, d)


EGO = "ego AS (SELECT video_id, floor(t / 24)::BIGINT AS day, median(vx) AS ex, median(vy) AS ey FROM ve GROUP BY 1, 2)"


def ego(spark, d):
    return velocities(spark, d).groupBy("video_id", F.floor(F.col("t") / 24).cast("long").alias("day")).agg(F.median("vx").alias("ex"), F.median("vy").alias("ey"))


@query(f"WITH {TRACKS}, {EGO} SELECT video_id, day, ex, ey FROM ego")
def ego_motion(spark, d):
    return ego(spark, d)


@query(f"""WITH {TRACKS}, {EGO}, sp AS (SELECT ve.video_id, class_name, t, event_id, sqrt(pow(vx - coalesce(ex, 0), 2) + pow(vy - coalesce(ey, 0), 2)) < 5 AS flag FROM ve LEFT JOIN ego ON ego.video_id = ve.video_id AND ego.day = floor(ve.t / 24)),
f AS (SELECT *, lag(flag) OVER (PARTITION BY video_id, class_name ORDER BY t, event_id) AS before FROM sp),
r AS (SELECT *, sum(CASE WHEN NOT flag OR NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, class_name ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT video_id, class_name, min(t) AS t0, max(t) AS t1, count(*) AS n FROM r WHERE flag GROUP BY video_id, class_name, run HAVING max(t) - min(t) >= 8""")
def stalled_tracks(spark, d):
    """Runs of 8 hours or more in which an object moves slowly beside its surroundings."""
    v = velocities(spark, d).withColumn("day", F.floor(F.col("t") / 24).cast("long")).join(ego(spark, d), ["video_id", "day"], "left")
    speed = F.sqrt(F.pow(F.col("vx") - F.coalesce("ex", F.lit(0.0)), 2) + F.pow(F.col("vy") - F.coalesce("ey", F.lit(0.0)), 2))
    return I.sustained_runs(v, ["video_id", "class_name"], "t", speed < 5, 8.0, ["t", "event_id"])


CONGESTION = """c0 AS (SELECT video_id % 3 AS scene, floor(t)::BIGINT AS bin, vx FROM ve), h AS (SELECT scene, bin, count(*) AS vehicles, coalesce(median(abs(vx)), 0) AS speed FROM c0 GROUP BY 1, 2),
m AS (SELECT scene, coalesce(median(speed) FILTER (speed > 0), 1e-6) AS reference FROM h GROUP BY 1), k AS (SELECT h.scene, bin, vehicles >= {vehicles} AND speed < {share} * reference AS flag, vehicles FROM h JOIN m ON m.scene = h.scene),
f AS (SELECT *, lag(flag) OVER (PARTITION BY scene ORDER BY bin) AS before FROM k), r AS (SELECT *, sum(CASE WHEN NOT flag OR NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY scene ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT scene, min(bin) AS t0, max(bin) AS t1, count(*) AS n, max(vehicles) AS peak FROM r WHERE flag GROUP BY scene, run HAVING max(bin) - min(bin) >= {least}"""


def scenes(spark, d):
    v = velocities(spark, d)
    return v.select((F.col("video_id") % 3).alias("scene"), F.floor("t").cast("long").alias("bin"), F.abs("vx").alias("speed"))


@query(f"WITH {TRACKS}, {CONGESTION.format(vehicles=8, share=0.45, least=6)}")
def congestion(spark, d):
    """Runs of six hours or more with eight objects or more at a median speed below 0.45 of the scene's usual one."""
    return R.congestion(scenes(spark, d), ["scene"], "bin", "speed")


@query(f"WITH {TRACKS}, {CONGESTION.format(vehicles=2, share=0.95, least=1)}")
def congestion_mild(spark, d):
    """The same with limits that the events table meets more often."""
    return R.congestion(scenes(spark, d), ["scene"], "bin", "speed", vehicles=2, share=0.95, least=1.0)


HOURLY = f"{SPANS}, h0 AS (SELECT video_id, floor(t0)::BIGINT AS t, avg(value) AS x, min(event_id) AS event_id FROM spans GROUP BY 1, 2), h AS (SELECT h0.*, EXISTS (SELECT 1 FROM spans e WHERE e.class_name = 'error' AND e.video_id = h0.video_id AND h0.t >= e.t0 AND h0.t <= e.t1) AS label FROM h0)"
Z = "z0 AS (SELECT *, median(x) OVER (PARTITION BY video_id) AS m, stddev_pop(x) OVER (PARTITION BY video_id) AS sd FROM h), z1 AS (SELECT *, median(abs(x - m)) OVER (PARTITION BY video_id) * 1.4826::DOUBLE AS mad FROM z0), z AS (SELECT video_id, t, x, event_id, label, (x - m) / CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd ELSE 1 END AS z FROM z1)"


@query(f"WITH {HOURLY}, {Z} SELECT video_id, t, round(z, 6) AS z FROM z")
def robust_z(spark, d):
    return G.robust_z(B.hourly(spark, d), ["video_id"], "x").select("video_id", "t", F.round("z", 6).alias("z"))


@query(f"""WITH {HOURLY}, k AS (SELECT *, rank() OVER (PARTITION BY video_id ORDER BY x) + (count(*) OVER (PARTITION BY video_id, x) - 1) / 2.0::DOUBLE AS r FROM h),
s AS (SELECT video_id, sum(r) FILTER (label) AS s, count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS q FROM k GROUP BY 1)
SELECT video_id, CASE WHEN p > 0 AND q > 0 THEN (s - p * (p + 1) / 2) / (p * q) END AS auc FROM s""")
def auc_per_user(spark, d):
    return G.auc(B.hourly(spark, d), ["video_id"], "x", "label")


@query("SELECT user_id AS video_id, avg(CASE WHEN value > 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS moving, median(value) AS mid, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY 1")
def moving_fraction(spark, d):
    e = B.table(spark, d, "events").groupBy(F.col("user_id").alias("video_id"))
    return e.agg(F.avg((F.col("value") > 30).cast("double")).alias("moving"), F.median("value").alias("mid"), F.percentile("value", 0.9).alias("p90"))


@query(f"""WITH {HOURLY}, {Z}, th(least) AS (VALUES (2.0::DOUBLE), (2.5::DOUBLE), (3.0::DOUBLE), (4.0::DOUBLE)), s0 AS (SELECT least, video_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY least, video_id ORDER BY t) <= 2 THEN 0 ELSE 1 END AS b FROM z JOIN th ON round(z, 9) >= least),
s1 AS (SELECT *, sum(b) OVER (PARTITION BY least, video_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM s0), s AS (SELECT least, video_id, min(t) AS at FROM s1 GROUP BY least, video_id, run),
e AS (SELECT video_id, event_id, t0 FROM spans WHERE class_name = 'error'),
a AS (SELECT least, count(*) AS spikes, count(*) FILTER (EXISTS (SELECT 1 FROM e WHERE e.video_id = s.video_id AND abs(s.at - e.t0) <= 3)) AS right_ FROM s GROUP BY 1),
f AS (SELECT th.least, count(*) FILTER (EXISTS (SELECT 1 FROM s WHERE s.least = th.least AND s.video_id = e.video_id AND abs(s.at - e.t0) <= 3)) AS found, count(*) AS starts FROM th, e GROUP BY 1)
SELECT f.least, coalesce(spikes, 0) AS spikes, coalesce(right_, 0) / nullif(spikes, 0)::DOUBLE AS precision, found / starts::DOUBLE AS recall FROM f LEFT JOIN a ON a.least = f.least""")
def spike_precision_recall(spark, d):
    """Spikes against starts within 3 hours, both ways, for several thresholds."""
    z = G.robust_z(B.hourly(spark, d), ["video_id"], "x").withColumn("least", F.explode(F.array(*map(F.lit, (2.0, 2.5, 3.0, 4.0))))).where(F.round("z", 9) >= F.col("least"))
    s = I.spike_groups(z, ["least", "video_id"], "t", 2.0).alias("s")
    e = B.spans(spark, d).where("class_name = 'error'").select("video_id", "event_id", "t0").alias("e")
    near = (F.col("s.video_id") == F.col("e.video_id")) & (F.abs(F.col("s.at") - F.col("e.t0")) <= 3)
    hits = s.join(e, near, "left_semi").groupBy("least").agg(F.count("*").alias("hits"))
    found = s.join(e, near).select("s.least", "e.event_id").distinct().groupBy("least").agg(F.count("*").alias("found"))
    every = spark.createDataFrame([(2.0,), (2.5,), (3.0,), (4.0,)], "least double").join(F.broadcast(e.agg(F.count("*").alias("starts"))))
    out = every.join(s.groupBy("least").agg(F.count("*").alias("spikes")), "least", "left").join(hits, "least", "left").join(found, "least", "left").na.fill(0)
    return out.select("least", "spikes", S.ratio(F.col("hits"), F.col("spikes"), None).alias("precision"), S.ratio(F.col("found"), F.col("starts"), None).alias("recall"))


@query()
def permutation_null(spark, d):
    """How often 2000 seeded draws of each user's hours do as well as the spikes, in precision and in recall, for three thresholds.

    real, null_mean and p are of precision; those of recall have their own names.
    """
    z = G.robust_z(B.hourly(spark, d), ["video_id"], "x").select("video_id", "t", F.round("z", 9).alias("z"))
    e = B.spans(spark, d).where("class_name = 'error'").select("video_id", "t0")
    shares = G.permutation_null(z, e, "video_id", [2.0, 2.5, 3.0], 2.0, 3.0, 2000, 7)
    draw = F.col("trial") >= 0
    w = Window.partitionBy("least")
    real = {c: F.max(F.when(~draw, F.col(c))).over(w).alias(f"real_{c}") for c in ("precision", "recall")}
    out = shares.select("*", *real.values()).where(draw).groupBy("least")
    p = lambda c: F.count_if(F.col(c) >= F.col(f"real_{c}")) / F.count("*")
    # every trial has as many spikes and starts, so the mean of the shares is a share of sums, which no order of rows changes
    whole = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0))
    out = out.agg(F.first("real_precision").alias("real"), whole("near", "spikes").alias("null_mean"), p("precision").alias("p"), F.first("real_recall").alias("real_recall"), whole("found", "starts").alias("null_recall"), p("recall").alias("p_recall"))
    return out.orderBy("least")


# vectors


@query("""WITH s AS (SELECT vec_id // 8 AS seq, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT seq, CAST(pos AS INTEGER) AS pos, round(avg(v), 6) AS mean FROM s GROUP BY 1, 2""")
def embedding_mean_pool(spark, d):
    return G.mean_pool(B.sequences(spark, d), ["seq"], "embedding").withColumn("mean", F.round("mean", 6))


@query("""WITH s AS (SELECT vec_id // 8 AS seq, list(vec_id ORDER BY vec_id) AS ids FROM embeddings GROUP BY 1), p AS (SELECT seq, list_concat(ids, list_transform(range(12), lambda i: ids[len(ids)]))[1:12] AS ids FROM s) SELECT seq, ids[1] AS first, ids[8] AS eighth, ids[12] AS last FROM p""")
def embedding_pad(spark, d):
    """Sequences of 12 frames, the last one repeated."""
    s = B.sequences(spark, d).groupBy("seq").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("ids", G.pad(F.col("ids"), 12))
    return s.select("seq", F.get("ids", F.lit(0)).alias("first"), F.get("ids", F.lit(7)).alias("eighth"), F.get("ids", F.lit(11)).alias("last"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS e, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings)
SELECT vec_id, CAST(best AS INTEGER) AS best, round(e[best + 1] / list_sum(e), 6) AS p FROM e""")
def softmax_argmax(spark, d):
    e = B.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    e = e.withColumn("p", G.softmax(F.col("x"))).withColumn("best", G.argmax(F.col("x")))
    return e.select("vec_id", "best", F.round(F.get("p", F.col("best")), 6).alias("p"))


@query("SELECT label, count(*) AS n, sqrt((SELECT count(*) FROM embeddings) / greatest(count(*), 1)::DOUBLE) AS weight FROM embeddings GROUP BY 1")
def class_weights(spark, d):
    e = B.table(spark, d, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("n")).join(F.broadcast(e.agg(F.count("*").alias("total")))).select("label", "n", F.sqrt(F.col("total") / F.greatest("n", F.lit(1))).alias("weight"))


@query()
def head_accuracy(spark, d):
    """A weighted linear head on the vectors, trained on four fifths and tried on the rest."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    w = class_weights(spark, d).select("label", "weight")
    e = B.table(spark, d, "embeddings").join(F.broadcast(w), "label")
    e = e.select("vec_id", F.col("label").cast("double").alias("label"), "weight", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(5))
    model = LogisticRegression(weightCol="weight", maxIter=20).fit(e.where(part > 0))
    return model.transform(e.where(part == 0)).agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


# sets, order, scale


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def dedupe_first(spark, d):
    return B.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def dedupe_last(spark, d):
    return B.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""WITH h AS (SELECT event_id, event_type, ('0x' || substr(md5(CAST(event_id AS VARCHAR) || '/11'), 1, 8))::BIGINT AS h FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM h), c AS (SELECT *, greatest(1, floor(n * 0.2::DOUBLE)) AS cut FROM k)
SELECT event_id, event_type, CASE WHEN k <= cut THEN 'dev' ELSE 'train' END AS part FROM c UNION ALL SELECT event_id, event_type, 'train' FROM c WHERE n = cut""")
def hash_split(spark, d):
    """A repeatable split of each class into train and dev: the fifth of least hash, and at least one, to dev; a class that is all dev trains on that."""
    return G.hash_split(B.table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type", 0.2, 11)


@query("""SELECT l.l_orderkey, l.l_linenumber, date_diff('day', o.o_orderdate, l.l_shipdate) AS days FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE abs(date_diff('day', o.o_orderdate, l.l_shipdate)) <= 30""")
def lineitem_band_join(spark, d):
    li = B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    days = F.datediff("l_shipdate", "o_orderdate").cast("long")
    return li.join(o, "l_orderkey").select("l_orderkey", "l_linenumber", days.alias("days")).where(F.abs("days") <= 30)


@query("SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def orders_topk(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return B.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 3")
