"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bpe import encode_decode
from .common import table
from .exact_dedup import exact_dedup
from .language import language_id
from .licenses import license_scan
from .near_dup import jaccard_join
from .packing import best_fit_packing
from .quality import quality_rules
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_files import token_files
from .tokens import public


def op1_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op3_quality_rules(spark, sf_dir):
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))


def op6_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark, sf_dir):
    return best_fit_packing(table(spark, sf_dir, "documents"), public("word_bpe_49k.json"))


def op8_token_files(spark, sf_dir):
    return token_files(table(spark, sf_dir, "documents"), public("byte_bpe_50k.json"))


def op9_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op10_bpe(spark, sf_dir):
    return encode_decode(table(spark, sf_dir, "documents"), public("word_bpe_49k.json"))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


def queries():
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_quality_rules": op3_quality_rules,
        "op4_language_id": op4_language_id,
        "op6_license_scan": op6_license_scan,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_token_files": op8_token_files,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_bpe": op10_bpe,
    }


def oracle_sql():
    return {"op7_exact_dedup": OP7_SQL}
