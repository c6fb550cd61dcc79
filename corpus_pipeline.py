"""A training corpus from documents: quality rules, exact dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and gets what the one before it kept; all
but the last return the columns of documents. Null texts count as empty. Rows
are told apart even where they share a doc_id or have none, and of each group of
copies or near copies one row stays. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import table, written
from spanforge.llm.exact_dedup import first_rows
from spanforge.llm.near_dup import first_of_each
from spanforge.llm.packing import best_fit_packing
from spanforge.llm.quality import quality_rules
from spanforge.llm.substring_dedup import substring_dedup
from spanforge.llm.tokens import public

#: The plan's stages hold hashed n-grams and token ids, which DuckDB's SQL cannot compute.
ORACLE_SQL = None


def whole(docs: DataFrame):
    """A row with all its columns, as _row."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows = docs.select("doc_id", "text", whole(docs))
    return quality_rules(rows, table(spark, sf_dir, "labels"), keep=("_row",)).where("kept").select("_row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of equal texts."""
    return first_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each component of near duplicates."""
    return first_of_each(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the words that earlier ones have in the same 50-word windows; one that loses none keeps its text as it is."""
    rows = docs.select("doc_id", "text", whole(docs))
    out = substring_dedup(rows, carry=("_row",))
    text = F.when(F.col("n_removed") > 0, F.decode("kept", "UTF-8")).otherwise(F.col("_row.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("_row.n_chars"))}
    return out.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of 4096 tokens."""
    return best_fit_packing(docs, public("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("substring dedup", substring), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
