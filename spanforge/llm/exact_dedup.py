"""Exact dedup (7), native: local dedup, merging of salted digest groups, winners combined globally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, identified, join_classes, own_ids, written

#: Copies of one text meet in at most so many groups before the winners are combined.
SALTS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are equal when identical after each run of white space becomes one
    space; null equals empty. One row of a group stays, that of the smallest
    doc_id, a null one only where there is no other; of rows that share it the
    first by a hash of the whole text. An empty table gives no rows.

    Each map task folds its own copies (the partial aggregate), salted groups
    fold those of a digest, and the winners of the salts are folded at last. All
    three have the whole text in the key, so a digest shared by two texts splits
    into two groups. Members find their group by digest alone unless some digest
    has two texts; then the text is in that join too.
    """
    rows, back = identified(docs, lead=True)
    return own_ids(grouped(rows, digest, salts), back, "doc_id", "keep_id")


def first_rows(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """The rows of docs that exact_dedup keeps, one of each group, with all columns."""
    rows, _ = identified(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")), "_row", lead=True)
    gone = grouped(rows.drop("_row"), digest, salts).where("NOT kept").select("doc_id")
    return rows.join(gone, "doc_id", "left_anti").select("_row.*")


def grouped(rows: DataFrame, digest, salts: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of rows whose doc_id are different; lead, where rows have it, tells those without an id in the table."""
    known = F.col("lead" if "lead" in rows.columns else "doc_id") != NULL_ID
    rows = rows.select("doc_id", F.when(known, F.col("doc_id")).alias("known"), normalised(F.col("text")).alias("norm"))
    rows = rows.select("doc_id", "known", "norm", digest(F.col("norm")).alias("digest"))
    salted = rows.groupBy("digest", "norm", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")).agg(F.min("known").alias("known"), F.min("doc_id").alias("least"), F.count("*").alias("group_size"))
    classes = salted.groupBy("digest", "norm").agg(F.coalesce(F.min("known"), F.min("least")).alias("keep_id"), F.sum("group_size").alias("group_size"))
    lean = written(classes.select("digest", "keep_id", "group_size"))
    key, members = "digest", rows.select("doc_id", "digest")
    if not lean.groupBy("digest").count().where("count > 1").isEmpty():
        key, members = "pair", rows.select("doc_id", "digest", F.struct("digest", "norm").alias("pair"))
        lean = written(classes.select(F.struct("digest", "norm").alias("pair"), "keep_id", "group_size"))
    members = written(members)
    # a clash's texts are too long to broadcast
    out = join_classes(members, lean, key, "group_size", members.count()) if key == "digest" else members.join(lean, key)
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
