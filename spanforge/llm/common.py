"""What the operators share: tables, the shared scratch folder, skew-safe joins.

Conventions of this subpackage, unless an operator says otherwise:

- an operator reads `doc_id` and `text` only, so extra columns of any name are
  ignored; a null text counts as an empty one;
- a null doc_id sorts before all others and comes back as null;
- rows that repeat a doc_id are documents of their own, and none of them has a
  smaller doc_id than another.
"""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Classes with more than one in HOT of all rows are fewer than HOT, so that broadcasting them is safe at any size.
HOT = 4096

#: A null doc_id inside the operators.
NULL_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir). Only where none is named and Spark runs in one process, as in tests, a local one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), f"spanforge-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/spanforge/{uuid.uuid4().hex}"


def written(df: DataFrame, large: bool = False) -> DataFrame:
    """df, written to the shared folder and read back: cuts the lineage and survives the loss of executors. large: frees the shuffles behind it at once."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    if large:
        release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """df, dealt by key and written to the shared folder as a table that joins on key read without a shuffle of it, and the table's name, to be dropped."""
    n, name = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), f"spanforge_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", scratch(df.sparkSession)).bucketBy(n, key).saveAsTable(name)
    release(df.sparkSession)
    return df.sparkSession.table(name), name


def no_text_is_empty(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (nulls as NULL_ID) and text (nulls as ''), and the columns named in more."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def null_id(c: str = "doc_id"):
    return F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)


def join_classes(rows: DataFrame, classes: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """rows joined to classes, which has one row per key and in `size` the number of rows with it.

    Classes that hold more than one in HOT of the n_rows rows number fewer than
    HOT and are broadcast; no key of the rest holds more than that share, so the
    shuffle deals them evenly. rows should be cheap to read twice.
    """
    hot = F.broadcast(classes.where(F.col(size) > n_rows / HOT))
    cold = classes.where(F.col(size) <= n_rows / HOT)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def let(value, body):
    """body(x), x being the value, which is computed once and not again by each use in a lambda."""
    return F.transform(F.array(value), body)[0]


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to any more; else they stay until the driver happens to collect its garbage.

    The pause lets Spark's own listeners forget the last query first.
    """
    time.sleep(1)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def no_collection():
    """For loops that fill caches and make no cycles: the collector would walk the caches over and over."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def ids_repeat(rows: DataFrame) -> bool:
    return not rows.groupBy("doc_id").count().where("count > 1").isEmpty()


def identified(docs: DataFrame, *more: str, lead: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, text and the columns in more, each row with an id of its own, and what brings the ids back: (doc_id, own), or None where they are the table's.

    Only where ids repeat are rows numbered, in order of (doc_id, hash of the
    text); with lead, those rows then have a column `lead`, the table's id, in
    whose order they stand.
    """
    rows = no_text_is_empty(docs, *more)
    if not ids_repeat(rows):
        return rows, None
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered = written(ordered.select(F.col("doc_id").alias("own"), F.monotonically_increasing_id().alias("doc_id"), "text", *more))
    return ordered.withColumnRenamed("own", "lead") if lead else ordered.drop("own"), ordered.select("doc_id", "own")


def own_ids(out: DataFrame, back: DataFrame | None, *columns: str) -> DataFrame:
    """out with the table's own ids in the columns."""
    for c in columns:
        if back is not None:
            names = out.columns
            out = out.join(back.withColumnRenamed("doc_id", c), c).drop(c).withColumnRenamed("own", c).select(*names)
        out = out.withColumn(c, F.when(F.col(c) != NULL_ID, F.col(c)))
    return out
