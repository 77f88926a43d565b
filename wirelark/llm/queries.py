"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizer_files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelark.llm import ann, bpe, packing, pii, quality, secrets, sharding, simhash, tokencount, warc
from wirelark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(table(spark, sf_dir, "documents"), sharding.HashTree.even(2, 2, 2))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, link=simhash.Link(2), seeds=(42,))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")


def op6_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer_files.path("byte_bpe_50k.json"), tokenizer_files.PATTERN, limit=512)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_files.path("byte_bpe_50k.json"), tokenizer_files.PATTERN, capacity=2048, end_id=0)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=1000)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_files.path("byte_bpe_multi_50k.tiktoken"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality, op2_ann, op3_sharding, op4_pii, op5_simhash, op6_tokencount, op7_packing, op8_secrets, op9_warc, op10_bpe)}


#: The other operators hash, tokenise or learn in ways that DuckDB can't express; tests hold them against brute force.
OP9_SQL = """
SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM (SELECT page_id, body, CASE WHEN octet_length(encode(body)) >= 1000 AND page_id IS DISTINCT FROM max(page_id) OVER (PARTITION BY body) THEN max(page_id) OVER (PARTITION BY body) END AS refers_to
  FROM (SELECT page_id, coalesce(html, '') AS body FROM pages))"""


def oracle_sql() -> dict[str, str]:
    return {"op9_warc": OP9_SQL}
