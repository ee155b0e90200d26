"""The corpus pipeline: language ID, near-dedup, decontamination, mixing to target weights, token files.

Each stage works on all that the one before it kept and returns the columns of ``documents``; the last one
returns what was read back from the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import decontaminate, hyperminhash, language_id, mixing, token_files
from rasterloom.runtime import staged, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: no letters, or a tie between languages."""
    return language_id.kept(docs, language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"), 4, 2))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group. Of rows that repeat a doc_id or have none, one of each distinct
    text stays."""
    return hyperminhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or an edited copy of one. Null and empty texts, and all
    texts where there are no items, stay; repeated rows share their fate."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each row as often as the mix takes it; rows that it doesn't take, and those without words, go.
    Rows that repeat a doc_id, or have none, are documents of their own."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns one row per document copy, read back from them; a null text has its
    end id only, and copies of one document follow each other."""
    return token_files.token_digest(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_to_weights),
    ("token_files", write_tokens),
]

#: Compression classes, alignments and the tokenizer have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
