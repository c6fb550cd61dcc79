"""The sweep against a plain loop over its configurations, and what it shuffles."""

import random

import numpy as np
import pyarrow as pa
import pytest

from spanforge.operators import sweep as W

COLUMNS = "video_id long, class_name string, t0 double, t1 double, confidence double, event_id long"
RULES = [(c, g, d) for c in (0.0, 0.5) for g in (0.0, 2.0, 5.0) for d in (0.0, 3.0)]


def some(n, seed):
    """Spans on a coarse grid of times, so that ties, empty spans and touching ends abound; some lack an end, a class or a confidence."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a = float(r.randrange(60))
        rows.append((r.randrange(3), r.choice(["a", "b", "b", None]), a, r.choice([a + r.randrange(9)] * 9 + [None]), r.choice([0.1, 0.5, 0.9, None]), i))
    return rows


def plain(truth, pred, rule, threshold=0.3):
    """tp and number of merged predictions under one configuration."""
    conf, gap, least = rule
    tp = n = 0
    for key in sorted({x[:2] for x in truth + pred}, key=str):
        runs = []
        for x in sorted((x for x in pred if x[:2] == key and x[4] is not None and x[4] >= conf), key=lambda x: (x[2], x[5])):
            ends = [y[1] for y in runs if y[1] is not None]
            if ends and x[2] <= max(ends) + gap:
                runs[-1][1] = max(e for e in (runs[-1][1], x[3]) if e is not None)
            else:
                runs.append([x[2], x[3]])
        runs = [x for x in runs if x[1] is not None and x[1] - x[0] >= least]
        n += len(runs)
        if None in key:
            continue
        pairs = []
        for i, g in enumerate(sorted((x for x in truth if x[:2] == key), key=lambda x: (x[2], x[5]))):
            for j, (a, b) in enumerate(runs):
                both = 0 if g[3] is None else min(g[3], b) - max(g[2], a)
                if both > 0 and both / (g[3] - g[2] + b - a - both) >= threshold:
                    pairs.append((-both / (g[3] - g[2] + b - a - both), i, j))
        gs, ps = set(), set()
        for _, i, j in sorted(pairs):
            if i not in gs and j not in ps:
                gs.add(i)
                ps.add(j)
        tp += len(gs)
    return tp, n


def test_sweep_is_the_plain_loop(spark):
    truth, pred = some(150, 1), some(200, 2)
    configs = spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "grid_ord int, min_conf double, gap_tol double, min_dur double")
    got = W.sweep(*(spark.createDataFrame(x, COLUMNS) for x in (truth, pred)), configs, 0.3).orderBy("grid_ord").collect()
    want = [plain(truth, pred, r) for r in RULES]
    assert [(r["tp"], r["fa"] + r["tp"], r["miss"] + r["tp"]) for r in got] == [(tp, n, len(truth)) for tp, n in want]
    empty = W.sweep(*(spark.createDataFrame([], COLUMNS) for _ in range(2)), configs, 0.3).collect()
    assert sorted(tuple(r) for r in empty) == [(i, 0, 0, 0) for i in range(len(RULES))]


@pytest.mark.parametrize(("most", "batch"), [(1, 1), (7, 3), (40, 11), (1 << 18, 1000)])
def test_blocks_change_nothing(most, batch):
    truth, pred = ([x for x in some(n, s) if x[1] and x[3] is not None and x[4]] for n, s in ((150, 3), (200, 4)))
    rows = sorted([(*x, True) for x in truth] + [(*x, False) for x in pred], key=lambda x: (x[0], x[1], x[2], x[5]))
    first = [i == 0 or rows[i][:2] != rows[i - 1][:2] for i in range(len(rows))]
    columns = [np.array(first), *(np.array([x[k] for x in rows]) for k in (6, 2, 3, 4))]
    total = np.zeros((len(RULES), 2), np.int64)
    blocks = list(W.islands(([x[k : k + batch] for x in columns] for k in range(0, len(rows), batch)), 5.0, 0.3, most))
    for group, block in blocks:
        total += W.counts(group, *block[1:], RULES, 0.3)
    assert (len(blocks) == 1) == (most > len(rows)) and sum(len(g) for g, _ in blocks) == len(rows)
    assert [tuple(x) for x in total.tolist()] == [plain(truth, pred, r) for r in RULES]


def test_taken_is_greedy_where_rounds_run_out():
    """A chain, of which each round takes just one pair."""
    n = 4 * W.ROUNDS
    g, p = np.repeat(np.arange(n), 2)[1:], np.repeat(np.arange(n), 2)[:-1]
    assert W.taken(g, p, n, n) == n
    assert W.taken(g[1:], p[1:], n, n) == n - 1


def written(spark):
    """Rows shuffled since the session began."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_configurations_share_one_shuffle(spark):
    truth, pred = (spark.createDataFrame(some(400, s), COLUMNS) for s in (5, 6))
    before = written(spark)
    assert W.sweep(truth, pred, W.grid(spark), 0.3).count() == 72
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert 0 < written(spark) - before < 800 + 72 * 10


def test_best_shuffles_no_more_than_its_events(spark):
    from spanforge.plans import registry

    from .conftest import SF

    before = written(spark)
    best = registry.queries()["sweep_best"](spark, SF).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert 0 < written(spark) - before < 2 * spark.read.parquet(f"{SF}/events.parquet").count()
    assert [(-r["f1"], r["grid_ord"]) for r in best] == sorted((-r["f1"], r["grid_ord"]) for r in best) and len(best) == 10


def shuffled(spark):
    """Bytes shuffled since the session began."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_shuffle_is_narrow(spark):
    """Times of 16 bytes a row that nothing makes shorter, and little more."""
    n = 200_000
    rows = spark.range(n, numPartitions=2).selectExpr(
        f"id * 7919 % {n // 10} AS video_id", "element_at(array('click', 'view', 'purchase', 'signup', 'error'), int(1 + id % 5)) AS class_name", "720 * rand(1) AS t0", "720 + rand(2) AS t1", "int(100 * rand(3)) / 100 AS confidence", "id AS event_id"
    )
    before = shuffled(spark)
    W.sweep(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "grid_ord int, min_conf double, gap_tol double, min_dur double"), 0.3).collect()
    assert 0 < shuffled(spark) - before < 25 * n


@pytest.mark.parametrize("partitions", ["1", "200"])
def test_few_tasks_are_no_reason_for_large_sorts(spark, partitions):
    truth, pred = (spark.createDataFrame(some(400, s), COLUMNS) for s in (5, 6))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        plan = W.sweep(truth, pred, W.grid(spark), 0.3)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert str(max(W.PARTS, int(partitions))) in next(x for x in plan.splitlines() if "RepartitionBy" in x and "bucket" in x)


def test_no_number_is_above_all_confidences(spark):
    truth, pred = some(150, 7), [x[:4] + ((float("nan") if i % 3 else x[4]), x[5]) for i, x in enumerate(some(200, 8))]
    configs = spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "grid_ord int, min_conf double, gap_tol double, min_dur double")
    got = W.sweep(*(spark.createDataFrame(x, COLUMNS) for x in (truth, pred)), configs, 0.3).orderBy("grid_ord").collect()
    sure = [x[:4] + (2.0 if x[4] != x[4] else x[4], x[5]) for x in pred]
    assert [(r["tp"], r["fa"] + r["tp"]) for r in got] == [plain(truth, sure, r) for r in RULES]


@pytest.mark.parametrize(("most", "batch"), [(1, 1), (7, 3), (1 << 18, 50)])
def test_blocks_hold_every_row(most, batch):
    rows = [{"k": x[0], "c": x[1], "t": x[3], "id": x[5], "bucket": hash(x[:2]) % 4} for x in some(200, 9)]
    schema = pa.schema([("k", pa.int64()), ("c", pa.string()), ("t", pa.float64()), ("id", pa.int64()), ("bucket", pa.int32())])
    batches = [pa.RecordBatch.from_pylist(rows[i : i + batch], schema=schema) for i in range(0, len(rows), batch)]
    blocks = [x for b in W.packed(iter(batches), most) for x in b.to_pylist()]
    assert most == 1 or len(blocks) < len(rows)
    for bucket in range(4):
        got = W.unpacked([pa.RecordBatch.from_pylist([{"block": x["block"]}]) for x in blocks if x["bucket"] == bucket])
        assert [x for b in got for x in b.to_pylist()] == [{c: v for c, v in x.items() if c != "bucket"} for x in rows if x["bucket"] == bucket]


def test_firsts_of_keys_across_batches():
    rows = sorted(((x[0], x[1]) for x in some(60, 10)), key=str)
    want = [i == 0 or rows[i] != rows[i - 1] for i in range(len(rows))]
    for n in (1, 4, 60):
        batches = [pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in rows[i : i + n]], schema=pa.schema([("a", pa.int64()), ("b", pa.string())])) for i in range(0, len(rows), n)]
        empty = batches[0].slice(0, 0)
        assert [x for _, first in W.firsts([empty, *batches, empty], ["a", "b"]) for x in first.tolist()] == want
