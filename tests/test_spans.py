import pytest
from pyspark.sql import functions as F

from spanforge.functions import spans as S
from spanforge.functions import text as X
from spanforge.operators import islands as I
from spanforge.operators import matching as M
from spanforge.operators import timeline as T


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "want"), [((0, 10), (0, 10), 1.0), ((0, 5), (6, 9), 0.0), ((0, 5), (5, 9), 0.0), ((0, 20), (10, 30), 1 / 3), ((0, 20), (5, 10), 0.25), ((3, 3), (0, 9), 0.0), ((None, 3), (0, 9), None)])
def test_iou(spark, a, b, want):
    lit = lambda x: F.lit(x).cast("double")
    for p, q in ((a, b), (b, a)):
        got = value(spark, S.iou(*map(lit, p), *map(lit, q)))
        assert got is None if want is None else abs(got - want) < 1e-12


def test_rates_of_nothing(spark):
    z = F.lit(0)
    assert value(spark, S.precision(z, z)) == value(spark, S.recall(z, z)) == value(spark, S.f1(z, z, z)) == 1.0
    assert value(spark, S.precision(z, z, None)) is None
    assert value(spark, S.f1(z, F.lit(1), F.lit(1))) == 0.0
    assert [value(spark, c(z, z, z)) for c in (S.credit_f1, S.credit_exact, S.credit_recall)] == [1.0] * 3
    assert value(spark, S.credit_f1(F.lit(1), F.lit(1), F.lit(0))) == 2 / 3


def pairs(spark, truth, pred):
    cols = "video_id int, class_name string, t0 double, t1 double, {} int"
    return (spark.createDataFrame([(1, "a", *map(float, t), i) for i, t in enumerate(x)], cols.format(n)) for x, n in ((truth, "gi"), (pred, "pi")))


@pytest.mark.parametrize(
    ("truth", "pred", "options", "want"),
    [
        ([(20, 40)], [(35, 55)], {}, []),
        ([(20, 40)], [(25, 45)], {}, [(0, 0)]),
        ([(20, 40)], [(22, 44), (20, 40)], {}, [(0, 1)]),
        ([(30, 35)], [(41, 46)], {}, []),
        ([(30, 35)], [(41, 46)], {"tolerance": 15.0}, [(0, 0)]),
        ([(0, 10), (0, 10)], [(0, 10)], {}, [(0, 0)]),
        ([(0, 10)], [(90, 99)], {"temporal": False}, [(0, 0)]),
    ],
)
def test_matching(spark, truth, pred, options, want):
    g, p = pairs(spark, truth, pred)
    assert [(r["gi"], r["pi"]) for r in M.greedy_match(M.candidates(g, p, **options)).collect()] == want


def plain_windows(d, win, hop, single):
    if d <= single:
        return [(0.0, d)]
    out, t = [], 0.0
    while t < d:
        out.append((t, min(t + win, d)))
        if t + win >= d:
            break
        t += hop
    return out


@pytest.mark.parametrize(("win", "hop", "single"), [(20.0, 10.0, 30.0), (20.0, 20.0, 20.0), (5.0, 8.0, 0.0)])
def test_plan_windows(spark, win, hop, single):
    df = spark.range(1, 130).select((F.col("id") / 2).alias("d")).select("d", T.plan_windows("d", win, hop, single).alias("w"))
    for r in df.collect():
        assert [(w["t0"], w["t1"]) for w in r["w"]] == plain_windows(r["d"], win, hop, single)


def test_bounds_of_gaps(spark):
    rows = [(1, "a", 0.0, 4.0, 0.5, 1), (1, "a", 6.0, 7.0, 0.5, 2), (1, "a", 9.01, 10.0, 0.9, 3), (1, "a", 9.5, 9.6, 0.9, 4)]
    df = spark.createDataFrame(rows, "video_id int, class_name string, t0 double, t1 double, confidence double, event_id int")
    got = I.coalesce_spans(df, ["video_id", "class_name"], 2.0, extra={"best": I.first_best("event_id")}).orderBy("t0").collect()
    assert [(r["t0"], r["t1"], r["n"], r["best"]) for r in got] == [(0.0, 7.0, 2, 1), (9.01, 10.0, 2, 3)]
    t = spark.createDataFrame([(1, float(x)) for x in (0, 2, 4.01, 9)], "k int, t double")
    assert [(r["at"], r["n"]) for r in I.spike_groups(t, ["k"], "t", 2.0).orderBy("at").collect()] == [(0.0, 2), (4.01, 1), (9.0, 1)]
    f = spark.createDataFrame([(1, float(i), c == "x") for i, c in enumerate("xx.xxx.x")], "k int, t double, f boolean")
    assert [(r["t0"], r["t1"]) for r in I.sustained_runs(f, ["k"], "t", F.col("f"), 1.0).orderBy("t0").collect()] == [(0.0, 1.0), (3.0, 5.0)]


def test_consensus_against_seed_loop(spark):
    import random

    r = random.Random(5)
    rows = [(v, "c", i, float(s := r.randrange(60)), float(s + r.randrange(0, 25)), r.random(), r.randrange(3)) for v in range(12) for i in range(25)]
    df = spark.createDataFrame([(v, c, 1000 * v + i, a, b, k, n) for v, c, i, a, b, k, n in rows], "video_id int, class_name string, event_id long, t0 double, t1 double, confidence double, run long")
    want = []
    for v in range(12):
        left = sorted((a, b, 1000 * v + i, k, n) for w, _, i, a, b, k, n in rows if w == v)
        while left:
            seed, rest, group = left[0], [], [left[0]]
            for x in left[1:]:
                longest = max(seed[1] - seed[0], x[1] - x[0])
                near = longest > 0 and max(0.0, min(seed[1], x[1]) - max(seed[0], x[0])) >= 0.1 * longest
                (group if near else rest).append(x)
            left = rest
            if len({g[4] for g in group}) >= 2:
                want.append((v, min(g[0] for g in group), min(70.0, max(g[1] for g in group)), max(g[3] for g in group), len({g[4] for g in group})))
    got = M.consensus(df, 70.0).collect()
    assert sorted((r["video_id"], r["t0"], r["t1"], r["confidence"], r["n_agree"]) for r in got) == sorted(want)


def test_strings(spark):
    assert value(spark, X.stem(F.lit("/a/b/T001.x.mp4"))) == "T001.x"
    assert value(spark, X.container_path(F.lit("out/a.mp4"), "/data")) == "/data/a.mp4"
    assert value(spark, X.window_key(F.lit("v"), F.lit(7))) == "v_w0007"
    assert value(spark, X.error_kind(F.lit("HTTP 429"))) == "rate limit"
    assert [value(spark, c) for c in X.byte_range(F.lit("bytes=-500"))] == [None, 500]
    assert tuple(value(spark, X.setting(F.lit("A = 'b=c'")))) == ("A", "b=c") and value(spark, X.setting(F.lit("# x=1"))) is None
    assert value(spark, X.prompt("is {s} long {k}", s=F.lit(20), k="x")) == "is 20.0 long x"
    assert value(spark, X.script_safe(F.lit("</script>"))) == "<\\/script>"
    assert value(spark, S.timecode(F.lit(125.25))) in ("2:05.3", "2:05.2")
    assert value(spark, X.ticks(F.lit(21.0))) == [0, 10, 20]
    assert value(spark, S.sample_times(F.lit(0.0), F.lit(4.0), 2)) == [1.0, 3.0]
