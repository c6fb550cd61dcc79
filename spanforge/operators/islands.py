"""Runs of rows that belong together: gap-tolerant coalescing and its relatives. All are one shuffle by the group's keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_runs(df: DataFrame, keys: list[str], order: list, begins: Column, name: str = "run") -> DataFrame:
    """df with the number of its run, `begins` telling for each row, in order, whether one begins there."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("_begins", F.coalesce(begins, F.lit(True)).cast("int"))
    return flagged.withColumn(name, F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")


def coalesce_spans(df: DataFrame, keys: list[str], gap: float, order: list | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """Spans (t0, t1) that follow within `gap` of the furthest end so far become one.

    Gives keys, t0, t1, confidence (the greatest), n, and explanation-like
    columns through `extra`. Needs t1 >= t0 and gap >= 0.
    """
    order = order or ["t0", "event_id"]
    w = Window.partitionBy(*keys).orderBy(*order)
    reach = F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = number_runs(df, keys, order, F.col("t0") > reach + gap)
    out = [F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.max("confidence").alias("confidence"), F.count("*").alias("n")]
    return runs.groupBy(*keys, "run").agg(*out, *(c.alias(n) for n, c in (extra or {}).items())).drop("run")


def first_best(value: str, score: str = "confidence", tie: str = "event_id") -> Column:
    """The value of the first row with the greatest score."""
    return F.max_by(value, F.struct(F.col(score), -F.col(tie)))


def merge_consecutive(df: DataFrame, keys: list[str], label: str, gap: float, least: float) -> DataFrame:
    """Neighbouring spans of the same label, less than `gap` apart, become one that ends with the last; those of `least` or less go."""
    w = Window.partitionBy(*keys).orderBy("t0", "event_id")
    joins = (F.lag(label).over(w) == F.col(label)) & (F.col("t0") - F.lag("t1").over(w) < gap)
    runs = number_runs(df, keys, ["t0", "event_id"], ~joins)
    out = runs.groupBy(*keys, "run", label).agg(F.min("t0").alias("t0"), F.max_by("t1", F.struct("t0", "event_id")).alias("t1"), F.count("*").alias("n"))
    return out.where(F.col("t1") - F.col("t0") > least).drop("run")


def sustained_runs(df: DataFrame, keys: list[str], t: str, flag: Column, least: float, order: list | None = None) -> DataFrame:
    """Maximal runs of rows with the flag, from the first's time to the last's, that last at least so long."""
    order = order or [t]
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    w = Window.partitionBy(*keys).orderBy(*order)
    runs = number_runs(marked, keys, order, ~F.col("_flag") | ~F.coalesce(F.lag("_flag").over(w), F.lit(False)))
    out = runs.where("_flag").groupBy(*keys, "run").agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.count("*").alias("n"))
    return out.where(F.col("t1") - F.col("t0") >= least).drop("run")


def spike_groups(df: DataFrame, keys: list[str], t: str, gap: float, order: list | None = None) -> DataFrame:
    """Times more than `gap` after the one before begin a group; its first time stands for it."""
    order = order or [t]
    w = Window.partitionBy(*keys).orderBy(*order)
    runs = number_runs(df, keys, order, F.col(t) - F.lag(t).over(w) > gap)
    return runs.groupBy(*keys, "run").agg(F.min(t).alias("at"), F.count("*").alias("n")).drop("run")
