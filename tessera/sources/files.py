"""File trees, logs and benchmark tables as DataFrames, and appending to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as tx


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path (relative), parent, name, ext, depth, size, mtime; content is not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    root = folder.rstrip("/").split("://")[-1] + "/"
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + "/" * root.startswith("/") + _quoted(root.lstrip("/")), "")
    listed = raw.select(relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return listed.select("path", F.regexp_replace("path", r"/?[^/]*$", "").alias("parent"), tx.file_name(F.col("path")).alias("name"), tx.extension(F.col("path")).alias("ext"), tx.depth(F.col("path")).alias("depth"), "size", "mtime")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def read_files(spark: SparkSession, folder: str, encoding: str = "auto", max_size: int = 5 * 1024 * 1024) -> DataFrame:
    """Text of files by encoding, with kind and media type; instead of text, an error for what is too large or not of the encoding.

    The content of files that are too large is not read: the limit is a filter of the scan.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    kind = tx.classify(F.col("content"), F.col("path"))
    bad = F.lit(encoding == "utf-8") & ~F.is_valid_utf8(F.col("content").cast("string"))
    fits = raw.filter(F.col("length") <= max_size).select(
        "path", F.col("length").alias("size"), "modificationTime", kind.alias("kind"), tx.media_type(F.col("path"), kind == tx.BINARY).alias("media_type"),
        F.when(~bad, tx.decoded(F.col("content"), encoding)).alias("text"), F.when(bad, "NOT_UTF8").alias("error"),
    )
    named = F.when(tx.extension(F.col("path")).isin(*tx.BINARY_EXTENSIONS), tx.BINARY).alias("kind")
    large = raw.filter(F.col("length") > max_size).select(
        "path", F.col("length").alias("size"), "modificationTime", named, tx.media_type(F.col("path"), F.coalesce(named == tx.BINARY, F.lit(False))).alias("media_type"), F.lit(None).cast("string").alias("text"), F.lit("FILE_TOO_LARGE").alias("error"),
    )
    return fits.unionByName(large)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines logs with a fixed schema; lines that don't parse are in ``_corrupt_record``."""
    return spark.read.schema(schemas.LOG).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BENCHMARK).csv(path, header=True)


def append_benchmarks(rows: DataFrame, path: str) -> None:
    rows.select(*schemas.BENCHMARK.names).write.mode("append").csv(path, header=True)


def append_logs(rows: DataFrame, path: str) -> None:
    """Rows by the day of their timestamp."""
    rows.withColumn("date", F.substring("timestamp", 1, 10)).write.mode("append").partitionBy("date").json(path)
