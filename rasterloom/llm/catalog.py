"""Queries of the pipeline operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from . import attention_lm, decontaminate, hyperminhash, language_id, mixing, quality, token_files, url_filter, warc
from .trie_dedup import exact_owners


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.records_of_pages(table(spark, sf_dir, "pages")))
    return found.select("record_id", "url_key", "original_id", "status", warc.header_lines(found["headers"]).alias("header_lines"), "payload_digest")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_owners(table(spark, sf_dir, "documents"))


def op3_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_texts(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.RULES)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_hyperminhash": op3_hyperminhash,
    "op4_attention_lm": op4_attention_lm,
    "op5_token_files": op5_token_files,
    "op6_language_id": op6_language_id,
    "op7_url_filter": op7_url_filter,
    "op8_decontamination": op8_decontamination,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
}

ORACLES = {
    "op3_hyperminhash": hyperminhash.ORACLE,
    "op1_warc_revisits": warc.ORACLE,
    "op2_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, h AS text_sha256
FROM d JOIN g USING (norm)""",
    "op7_url_filter": url_filter.ORACLE,
    "op9_mixing": mixing.ORACLE,
}
