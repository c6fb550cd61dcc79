"""Connected components of a link table, by contraction; nothing but a yes or no reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of the links (a, b).

    In each round a node points to the node of least hash among itself and its
    neighbours, and links are carried over to where their ends point. Each round
    has a hash of its own, so that a chain is cut at places that do not depend on
    the rounds before, and shrinks by a constant factor in expectation. A hub is aggregated before the shuffle, and joins on it
    are skew joins that Spark splits.
    """
    links = written(links.where("a <> b").select("a", "b").distinct())
    found, k = None, 0
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("n"))
        to = both.groupBy("a").agg(F.min(ranked("b")).alias("least")).select(F.col("a").alias("node"), F.least("least", ranked("a"))["n"].alias("to"))
        to, k = written(to), k + 1
        if found is None:
            found = to
        else:
            found = written(found.join(to.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        links = links.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        links = written(links.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = found.groupBy("to").agg(F.min("node").alias("component"))
    return written(found.join(least, "to").select("node", "component"))
