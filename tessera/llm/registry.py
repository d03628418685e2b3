"""Queries of this subpackage over the given tables, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import oracles
from tessera.llm.byte_bpe import encode_documents
from tessera.llm.language import identify
from tessera.llm.lexical import rank_documents
from tessera.llm.licenses import scan_licenses
from tessera.llm.manifest import dataset_manifest
from tessera.llm.mixing import mix_copies
from tessera.llm.near_duplicates import link_documents
from tessera.llm.pii import find_pii
from tessera.llm.piece_bpe import encode_pieces
from tessera.llm.sharding import shard_by_bytes
from tessera.llm.token_counts import count_tokens
from tessera.llm.vectors import exact_top_k, forest_top_k

TOKEN_LIMIT = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_copies(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op2_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(_table(spark, sf_dir, "documents"), shards=24)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_top_k(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(_table(spark, sf_dir, "documents"), size=4, percent=85)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return dataset_manifest(_table(spark, sf_dir, "documents"), tampered=("n_chars", changed, F.col("n_chars").cast("decimal(20,0)") + 1))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_byte_shards": op2_byte_shards,
    "op3_personal_data": op3_personal_data,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_token_counts": op5_token_counts,
    "op6_forest_search": op6_forest_search,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_lexical_search": op11_lexical_search,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op4_exact_top_k": oracles.EXACT_TOP_K,
    "op9_license_scan": oracles.LICENSE_SCAN,
    "op10_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op11_lexical_search": oracles.LEXICAL_SEARCH,
    "op13_merkle_manifest": oracles.MERKLE_MANIFEST,
}
