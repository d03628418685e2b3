"""Documents through the stages of a training-data pipeline: each stage is one operator at work on what is left."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import encode_documents
from tessera.llm.language import UNDETERMINED, identify
from tessera.llm.mixing import mix_documents
from tessera.llm.near_duplicates import link_documents
from tessera.llm.pii import find_pii
from tessera.llm.places import bit_bucket, bit_position, has_bit
from tessera.llm.scratch import materialise

#: The columns of documents; a table's further columns are left out of the run, whatever their names.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies share this percentage of their word shingles of this size; the query op10_ngram_jaccard has its own.
NEAR_SIZE, NEAR_PERCENT = 5, 80
#: Bytes of known words, and rows of a query, in a worker that encodes: less than alone, as executors have grown by then.
ENCODE_KNOWN, ENCODE_ROWS = 25_000_000, 200_000
#: Bitmaps, of 4 kB for 32768 rows each, that are broadcast together.
BITMAPS = 1 << 14


def identify_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with that language in ``lang``; a null, empty or letterless text goes.

    Rows with null or repeated ids and repeated rows are told one by one; equal texts are told alike, ties by the name of
    the language; very long texts are read whole. An empty table, or one without a labelled row, gives no rows.
    """
    found = identify(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=True)
    return found.filter(F.col("lang_pred") != UNDETERMINED).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def keep_rows(numbered: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``numbered`` whose ``row`` is in ``kept``, without a shuffle of them: by bitmaps, up to BITMAPS of them.

    ``row`` counts upwards in each part of the table, so that bitmaps are dense. With more of them rows are joined.
    """
    bucket = bit_bucket(F.col("row")).alias("bucket")
    bits = materialise(kept.groupBy(bucket).agg(F.bitmap_construct_agg(bit_position(F.col("row"))).alias("bits")), "pipeline-kept")
    if bits.count() > BITMAPS:
        return numbered.join(kept, "row", "left_semi")
    return numbered.withColumn("bucket", bucket).join(F.broadcast(bits), "bucket").filter(has_bit(F.col("bits"), F.col("row")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, a null id being the greatest.

    Rows are told apart by numbers of their own, so null and repeated ids decide nothing but that order: rows of
    different texts all stay, and of copies under one id the one with the smallest hash of its text; of equal rows one.
    Null and empty texts are like nothing and stay. Very long texts are compared whole. An empty table gives no rows.
    """
    numbered = materialise(docs.withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")
    linked = link_documents(numbered.select(F.col("row").alias("doc_id"), "text"), size=NEAR_SIZE, percent=NEAR_PERCENT)
    ranked = numbered.select("row", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("hash"), "row").alias("rank"))
    member = linked.select(F.col("doc_id").alias("row"), "component_id").join(ranked, "row")
    first = member.groupBy("component_id").agg(F.min("rank").alias("first")).select(F.col("first.row").alias("row"))
    return keep_rows(numbered, first).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data in their texts replaced by its kind; n_chars follows the text.

    Every row stays, whatever its id, and repeated rows stay equal; a null text stays null, with a null n_chars. Of
    overlapping spans the kind of the first is written. Very long texts are masked whole.
    """
    return find_pii(docs, mask=True).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as a mix of their sources by target weight takes them; see :func:`mix_documents`.

    A null source is a source, the last one; rows with null or repeated ids are taken each for itself. Rows without
    words have no weight and are taken as often as all rows of their source are. An empty table gives no rows.
    """
    return mix_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents of the mix, with digests of the ids and of the decoded bytes, one row for each row.

    A null or empty text has no ids; very long texts and words are encoded whole; equal texts give equal rows.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_documents(docs, path, public_tokenizers.PATTERN, keep_ids=True, known=ENCODE_KNOWN, query_rows=ENCODE_ROWS)


STAGES = [
    ("language", identify_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", pii_stage),
    ("mix", mix_stage),
    ("encode", encode_stage),
]

#: Fitted models and hashes decide in every stage, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
