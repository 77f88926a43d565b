"""Corpus pipeline: stages over documents, each calling one operator of wirelark.llm.

Null texts fail the quality rules; empty tables pass through as empty tables. Columns beyond those of
documents are carried by all stages but the last.
"""

from __future__ import annotations

import public_tokenizers as tokenizer_files
from pyspark.sql import DataFrame, SparkSession

from wirelark.llm import packing, pii, quality, simhash
from wirelark.llm.common import fresh_path, materialise, scratch, table
from wirelark.shared import remove


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that no quality rule rejects. Null and empty texts are rejected; a repeated row is judged each time alike."""
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, that of least doc_id: five-word shingles, similarity of 0.8 or more.

    Empty texts are one group. Rows that repeat a kept document go; rows without doc_id stay.
    """
    return simhash.deduplicated(docs, shingle=5, similarity=0.8)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind, as [EMAIL]; n_chars follows. No row goes; null texts stay null."""
    return pii.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens; one row per piece. A null or empty text is one piece, of its end token."""
    return packing.pack(docs, tokenizer_files.path("byte_bpe_50k.json"), tokenizer_files.PATTERN, capacity=2048, end_id=0)


STAGES = [("quality", quality_stage), ("simhash_dedup", dedup_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: SQL can't express bootstrapped extraction and chained packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again before the next; what a stage leaves behind goes once it isn't needed."""
    docs, written = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = fresh_path(spark, "stage")
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), path)
        if written:
            remove(spark, written)
        written = path
    return STAGES[-1][1](spark, docs, sf_dir)
