"""Statistics of series, tracks, latencies and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Trials of a permutation null that are held at once.
CHUNK = 100


def robust_z(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """df with z: the distance from the median by 1.4826 MAD, else by the population deviation, else by 1."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("_m", F.median(x).over(w)).withColumn("_d", F.stddev_pop(x).over(w))
    df = df.withColumn("_mad", F.median(F.abs(F.col(x) - F.col("_m"))).over(w) * 1.4826)
    scale = F.when(F.col("_mad") > 0, F.col("_mad")).when(F.col("_d") > 0, F.col("_d")).otherwise(1.0)
    return df.withColumn("z", (F.col(x) - F.col("_m")) / scale).drop("_m", "_d", "_mad")


def auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Area under the curve by ranks, ties averaged; NULL where a class is absent."""
    w = Window.partitionBy(*keys)
    ranks = F.rank().over(w.orderBy(score)) + (F.count("*").over(Window.partitionBy(*keys, score)) - 1) / 2
    t = df.withColumn("_r", ranks).groupBy(*keys).agg(F.sum(F.when(F.col(label), F.col("_r"))).alias("s"), F.count_if(label).alias("p"), F.count_if(~F.col(label)).alias("q"))
    p, q = F.col("p"), F.col("q")
    return t.select(*keys, F.when((p > 0) & (q > 0), (F.col("s") - p * (p + 1) / 2) / F.nullif(p * q, F.lit(0))).alias("auc"))


def velocity(df: DataFrame, keys: list[str], t: str, x: str, y: str, order: list[str]) -> DataFrame:
    """df's rows with vx, vy since the row before; rows without one or without time between are left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    dt = F.col(t) - F.lag(t).over(w)
    df = df.withColumn("_dt", dt).withColumn("_dx", F.col(x) - F.lag(x).over(w)).withColumn("_dy", F.col(y) - F.lag(y).over(w))
    return df.where(F.col("_dt") > 0).withColumn("vx", F.col("_dx") / F.col("_dt")).withColumn("vy", F.col("_dy") / F.col("_dt")).drop("_dt", "_dx", "_dy")


def latency_profile(df: DataFrame, keys: list[str], ms: str) -> DataFrame:
    """Calls, total, mean, p50 and p95 by nearest rank, and the greatest."""
    counts = df.groupBy(*keys, F.col(ms).alias("_x")).agg(F.count("*").alias("_n"))  # equal values are one row from here on
    last = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_last", last).withColumn("_all", F.sum(F.when(F.col("_x").isNotNull(), F.col("_n"))).over(Window.partitionBy(*keys)))
    ranked = ranked.withColumn("_last", F.col("_last") - F.sum(F.when(F.col("_x").isNull(), F.col("_n")).otherwise(0)).over(Window.partitionBy(*keys)))
    at = lambda q: F.min(F.when(F.col("_x").isNotNull() & (F.col("_last") > F.floor(q * (F.col("_all") - 1))), F.col("_x")))
    t = ranked.groupBy(*keys).agg(F.sum("_n").alias("calls"), F.sum(F.col("_x") * F.col("_n")).alias("total_ms"), F.max("_x").alias("max_ms"), at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"), F.max("_all").alias("_all"))
    return t.withColumn("mean_ms", F.col("total_ms") / F.col("_all")).drop("_all")


def hash_split(df: DataFrame, key: str, label: str, share: float, seed: int) -> DataFrame:
    """df with part dev or train: of each label the share of least hash of the key, and at least one row, is dev; a label that is all dev has its rows in train too.

    Hashes fall into 65,536 bins; counts of bins tell how many rows of a label
    lie before one, so that only rows of the same label and bin are sorted together.
    """
    h = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}"))), 1, 8), 16, 10).cast("long")
    rows = df.withColumn("_h", h).withColumn("_bin", F.shiftright("_h", 16))
    of_label = Window.partitionBy(label)
    before = F.sum("_n").over(of_label.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = rows.groupBy(label, "_bin").agg(F.count("*").alias("_n")).select(label, "_bin", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(of_label).alias("_all"))
    rows = rows.join(bins, [label, "_bin"]).withColumn("_k", F.col("_before") + F.row_number().over(Window.partitionBy(label, "_bin").orderBy("_h", key)))
    cut = F.greatest(F.lit(1), F.floor(F.col("_all") * share))
    part = F.when(F.col("_k") > cut, F.array(F.lit("train"))).when(F.col("_all") == cut, F.array(F.lit("dev"), F.lit("train"))).otherwise(F.array(F.lit("dev")))
    return rows.select(*df.columns, F.explode(part).alias("part"))


def softmax(xs: Column) -> Column:
    top = F.array_max(xs)
    e = F.transform(xs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def argmax(xs: Column) -> Column:
    """Place, from 0, of the first greatest element."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def pad(xs: Column, n: int) -> Column:
    """The first n elements, the last one repeated where there are fewer."""
    return F.slice(F.concat(xs, F.array_repeat(F.element_at(xs, -1), n)), 1, n)


def mean_pool(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, pos, mean: the mean of each dimension over the group's vectors."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "v")).groupBy(*keys, "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def permutation_null(series: DataFrame, starts: DataFrame, key: str, thresholds: list[float], gap: float, reach: float, trials: int, seed: int) -> DataFrame:
    """least, trial, near, spikes, found, starts, precision, recall: the grouped spikes of series (key, t, z) against starts (key, t0) within reach, as trial -1,
    and as many times of each key, drawn seeded without replacement, as trials from 0 on. Precision is 0 where nothing spikes, recall where nothing starts.

    One key's times and starts are held at a time, and CHUNK trials of them.
    """
    import zlib

    import numpy as np
    import pandas as pd

    def run(name, a, b):
        a, first = a.sort_values("t"), np.sort(b["t0"].to_numpy(float))
        t, z = a["t"].to_numpy(float), a["z"].to_numpy(float)
        rng = np.random.default_rng([seed, zlib.crc32(repr(tuple(map(str, name))).encode())])
        near = np.searchsorted(first, t + reach, "right") > np.searchsorted(first, t - reach, "left")
        lo, hi = np.searchsorted(t, first - reach, "left"), np.searchsorted(t, first + reach, "right")

        def tally(mask):
            before = np.concatenate([np.zeros((len(mask), 1), np.int32), mask.cumsum(1, dtype=np.int32)], 1)
            return (mask & near).sum(1), (before[:, hi] > before[:, lo]).sum(1)

        out = []
        for least in thresholds:
            at = np.flatnonzero(z >= least)
            at = at[np.diff(t[at], prepend=-np.inf) > gap]
            n = len(at)
            real = np.zeros((1, len(t)), bool)
            real[0, at] = True
            tallies = [tally(real)]
            for k in range(0, trials, CHUNK):
                mask = np.zeros((min(CHUNK, trials - k), len(t)), bool)
                if n:
                    np.put_along_axis(mask, rng.random(mask.shape).argpartition(n - 1, 1)[:, :n], True, 1)
                tallies.append(tally(mask))
            hit, found = (np.concatenate([x[i] for x in tallies]) for i in (0, 1))
            out.append(pd.DataFrame({"least": least, "trial": np.arange(-1, trials), "near": hit, "spikes": n, "found": found, "starts": len(first)}))
        return pd.concat(out)

    rows = series.groupBy(key).cogroup(starts.groupBy(key)).applyInPandas(run, "least double, trial long, near long, spikes long, found long, starts long")
    sums = rows.groupBy("least", "trial").agg(*(F.sum(c).alias(c) for c in ("near", "spikes", "found", "starts")))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return sums.select("*", share("near", "spikes").alias("precision"), share("found", "starts").alias("recall"))
