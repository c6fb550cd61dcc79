"""Parameter sweeps: every configuration of a grid over one scan of truth and predictions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The grid, fixed values.
MIN_CONF, GAPS, MIN_DUR = (0.0, 0.25, 0.35, 0.5, 0.65, 0.8), (0.0, 3.0, 6.0, 12.0), (0.0, 1.0, 3.0)
#: Rows worked on at once, and pairs of a truth and a prediction scored at once.
ROWS, PAIRS = 1 << 18, 1 << 21
#: Rounds in which best pairs are taken all at once; the rest is taken one by one.
ROUNDS = 20
#: Parts that truth and predictions are dealt into at least; a task sorts one after another, so that few tasks are no reason to sort on disk.
PARTS = 64


def grid(spark, confs=MIN_CONF, gaps=GAPS, durs=MIN_DUR) -> DataFrame:
    """grid_ord, min_conf, gap_tol, min_dur: one row per configuration, in order of nesting."""
    rows = [(c, g, m) for c in confs for g in gaps for m in durs]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "grid_ord int, min_conf double, gap_tol double, min_dur double")


def reach(group: np.ndarray, t1: np.ndarray) -> np.ndarray:
    """The furthest end of the rows before, in the same group; -inf for its first. Exact: ends are compared by rank."""
    ends, rank = np.unique(t1, return_inverse=True)
    far = np.maximum.accumulate(group * np.int64(len(ends)) + rank)
    out = np.full(len(t1), -np.inf)
    same = group[1:] == group[:-1]
    out[1:][same] = ends[far[:-1][same] % len(ends)]
    return out


def pairs(gg, g0, g1, pg, p0, p1, threshold: float):
    """Truths and predictions of one group with an iou of the threshold, and that iou; the predictions of a group share no time and stand in order."""
    if threshold > 0:
        times, rank = np.unique(np.concatenate([g0, g1, p0]), return_inverse=True)
        wide, n = np.int64(len(times) + 1), len(g0)
        # the first prediction that ends after the truth starts, and the first that starts no earlier than the truth ends
        low = np.searchsorted(pg * wide + np.searchsorted(times, p1), gg * wide + rank[:n], "right")
        high = np.searchsorted(pg * wide + rank[2 * n :], gg * wide + rank[n : 2 * n], "left")
    else:
        low, high = np.searchsorted(pg, gg, "left"), np.searchsorted(pg, gg, "right")
    count = np.maximum(high - low, 0)
    ends, found, at = np.cumsum(count), [], 0
    while at < len(count):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        g = np.repeat(np.arange(at, to), count[at:to])
        p = np.arange(len(g)) - np.repeat(ends[at:to] - count[at:to] - done, count[at:to]) + low[g]
        both = np.minimum(g1[g], p1[p]) - np.maximum(g0[g], p0[p])
        joint = (g1[g] - g0[g]) + (p1[p] - p0[p]) - both
        with np.errstate(divide="ignore", invalid="ignore"):
            iou = np.where((both <= 0) | (joint <= 0), 0.0, both / joint)
        ok = iou >= threshold
        found.append((g[ok], p[ok], iou[ok]))
        at = to
    return [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]


def taken(g: np.ndarray, p: np.ndarray, n_truth: int, n_pred: int) -> int:
    """Number of pairs that the greedy order takes: each, in the order given, if both its sides are free.

    A pair that comes first for both of its sides is taken whatever happens
    elsewhere; so all such are taken at once, and what they bar goes.
    """
    out = 0
    for _ in range(ROUNDS):
        if not len(g):
            return out
        at = np.arange(len(g))
        first_g, first_p = np.full(n_truth, -1), np.full(n_pred, -1)
        first_g[g[::-1]], first_p[p[::-1]] = at[::-1], at[::-1]
        best = (first_g[g] == at) & (first_p[p] == at)
        out += int(best.sum())
        used_g, used_p = np.zeros(n_truth, bool), np.zeros(n_pred, bool)
        used_g[g[best]], used_p[p[best]] = True, True
        free = ~used_g[g] & ~used_p[p]
        g, p = g[free], p[free]
    used_g, used_p = set(), set()
    for x, y in zip(g.tolist(), p.tolist()):
        if x not in used_g and y not in used_p:
            used_g.add(x)
            used_p.add(y)
            out += 1
    return out


def packed(batches, most: int = ROWS):
    """Batches as blocks, one for each bucket of about `most` rows: bucket, and the rows' other columns as a compressed stream."""
    held, n = [], 0

    def blocks():
        rows = pa.Table.from_batches(held)
        bucket = rows["bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows.drop_columns("bucket").take(order), bucket[order]
        starts, out = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), []
        for a, b in zip(starts, [*starts[1:], len(bucket)]):
            block = rows.slice(a, b - a).combine_chunks()
            block = pa.table([c.dictionary_encode() if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c for c in block.columns], block.column_names)
            sink = pa.BufferOutputStream()
            with pa.CompressedOutputStream(sink, "zstd") as z, pa.ipc.new_stream(z, block.schema) as stream:
                stream.write_table(block)
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(out, pa.binary())], ["bucket", "block"])

    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= most:
            yield blocks()
            held, n = [], 0
    if n:
        yield blocks()


def unpacked(batches):
    """The rows of blocks."""
    for batch in batches:
        for block in batch["block"]:
            with pa.input_stream(block.as_buffer(), compression="zstd") as z:
                for rows in pa.ipc.open_stream(z):
                    yield pa.RecordBatch.from_arrays([c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in rows.columns], rows.schema.names)


def firsts(batches, keys: list):
    """Each batch, and which of its rows are the first of their keys; rows come in order of keys."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        first = np.zeros(len(batch), bool)
        for k in keys:
            code = batch[k].dictionary_encode("encode").indices.to_numpy()
            first[1:] |= code[1:] != code[:-1]
        first[0] = last != [batch[k][0].as_py() for k in keys]
        last = [batch[k][-1].as_py() for k in keys]
        yield batch, first


def islands(batches, widest: float, threshold: float, most: int = ROWS):
    """Blocks of whole islands from batches of (first of its video and class, truth, t0, t1, confidence), with each row's island.

    Where pairs need no overlap, an island is all of a video and class.
    """
    held, n, due = [], 0, most

    def cut(last):
        rows = [np.concatenate(x) for x in zip(*held)]
        begins = rows[0] | (rows[2] > reach(np.cumsum(rows[0]), rows[3]) + widest) if threshold > 0 else rows[0].copy()
        begins[0] = True
        return rows, np.cumsum(begins), n if last else int(np.flatnonzero(begins)[-1])

    for batch in batches:
        held.append(batch)
        n += len(batch[0])
        if n >= due:
            rows, group, at = cut(False)
            if at:
                yield group[:at], [x[:at] for x in rows]
            held, n = [[x[at:] for x in rows]], n - at
            due = max(most, 2 * n)
    if n:
        rows, group, _ = cut(True)
        yield group, rows


def counts(group, truth, t0, t1, confidence, configs: list, threshold: float) -> np.ndarray:
    """tp and number of merged predictions of each configuration, over whole groups in order of start."""
    out = np.zeros((len(configs), 2), np.int64)
    gg, g0, g1 = group[truth], t0[truth], t1[truth]
    for conf in sorted({c[0] for c in configs}):
        kept = ~truth & (confidence >= conf)
        pg, a, b = group[kept], t0[kept], t1[kept]
        if not len(pg):
            continue
        far, new = reach(pg, b), np.r_[True, pg[1:] != pg[:-1]]
        for gap in sorted({c[1] for c in configs if c[0] == conf}):
            starts = np.flatnonzero(new | (a > far + gap))
            rg, r0, r1 = pg[starts], a[starts], (np.maximum.reduceat(b, starts) + gap) - gap
            length = r1 - r0
            chosen = [(i, c[2]) for i, c in enumerate(configs) if c[:2] == (conf, gap)]
            long = length >= min(least for _, least in chosen)
            rg, r0, r1, length = rg[long], r0[long], r1[long], length[long]
            g, p, iou = pairs(gg, g0, g1, rg, r0, r1, threshold)
            order = np.lexsort((p, g, -iou))
            g, p = g[order], p[order]
            for i, least in chosen:
                ok = length[p] >= least
                out[i] += taken(g[ok], p[ok], len(g0), len(r0)), int((length >= least).sum())
    return out


def sweep(truth: DataFrame, pred: DataFrame, configs: DataFrame, threshold: float) -> DataFrame:
    """grid_ord, tp, fa, miss of each configuration's merged predictions against the truth (video_id, class_name, t0, t1, event_id).

    Truth and predictions are dealt by video and class once, whatever the number
    of configurations (a bounded list of the driver's making), and each task
    merges and matches its rows under one configuration after another. Only
    counts leave it. They are dealt as compressed blocks of columns, and of a
    confidence only the number of thresholds it reaches is kept. What a task
    holds is a block of rows, or the longest island: no later row starts within
    the greatest gap of an island's end, so neither merging nor matching crosses
    its border.
    """
    listed = [(r["min_conf"], r["gap_tol"], r["min_dur"], r["grid_ord"]) for r in configs.collect()]
    ords, rules = [x[3] for x in listed], [x[:3] for x in listed]
    widest, confs = max((x[1] for x in rules), default=0.0), sorted({x[0] for x in rules})
    keys, reached = ["video_id", "class_name"], np.array([0.0, *confs])

    def deal(batches):
        for b in batches:  # a truth has no confidence and reaches none; NaN is above all numbers, as for Spark and SQL
            x = b["level"]
            level = np.where(x.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(confs, x.to_numpy(zero_copy_only=False), "right"))
            yield b.set_column(b.schema.get_field_index("level"), "level", pa.array(level, pa.int32()))

    def run(batches):
        total = np.zeros((len(rules), 2), np.int64)
        rows = ((first, level == 0, t0, t1, reached[level]) for b, first in firsts(batches, keys) for t0, t1, level in [[b[c].to_numpy() for c in ("t0", "t1", "level")]])
        for group, block in islands(rows, widest, threshold):
            total += counts(group, *block[1:], rules, threshold)
        yield pa.RecordBatch.from_arrays([pa.array(ords, pa.int32()), pa.array(total[:, 0]), pa.array(total[:, 1])], ["grid_ord", "tp", "n_pred"])

    # what has no start, key or end can't be matched; a prediction without a start or end is no run, and adds nothing to one
    g = truth.where("video_id IS NOT NULL AND class_name IS NOT NULL AND t0 IS NOT NULL AND t1 IS NOT NULL")
    p = pred.where("t0 IS NOT NULL AND t1 IS NOT NULL").where(F.col("confidence") >= (confs[0] if confs else 0.0))
    columns = [*keys, "event_id", "t0", "t1"]
    both = g.select(*columns, F.lit(None).cast("double").alias("level")).unionByName(p.select(*columns, F.col("confidence").cast("double").alias("level")))
    tasks = int(truth.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(PARTS, tasks)
    dealt = both.withColumn("bucket", F.pmod(F.hash(*keys), F.lit(n))).mapInArrow(lambda x: packed(deal(x)), "bucket int, block binary").repartitionById(n, "bucket")
    rows = dealt.mapInArrow(unpacked, both.withColumn("level", F.lit(0)).schema).sortWithinPartitions(*keys, "t0", "event_id").coalesce(tasks).select(*keys, "t0", "t1", "level")
    # a row for each configuration and task: few parts, as each task writes a list of them
    found = rows.mapInArrow(run, "grid_ord int, tp long, n_pred long").repartition(8, "grid_ord").groupBy("grid_ord").agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"))
    out = configs.select("grid_ord").join(found, "grid_ord", "left").na.fill(0, ["tp", "n_pred"]).join(F.broadcast(truth.agg(F.count("*").alias("n_truth"))))
    return out.select("grid_ord", "tp", (F.col("n_pred") - F.col("tp")).alias("fa"), (F.col("n_truth") - F.col("tp")).alias("miss"))
