"""Contiguous shards of near-equal bytes, from global prefix sums over per-partition totals. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import materialise, partitions

#: A group of equal texts that lies across a cut stays whole if it has at most this share of a shard's bytes.
WHOLE_GROUP_SHARE = 1 / 32


def _shard_at(start: Column, size: Column, total: Column, shards: int) -> Column:
    """The shard in whose equal share of the total the middle of [start, start + size) falls; in whole numbers."""
    middle = (F.lit(shards) * (F.lit(2) * start + size)).cast("long")
    return F.least(F.lit(shards - 1), F.floor(middle / (F.lit(2) * total))).cast("int")


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, whole_group_share: float = WHOLE_GROUP_SHARE) -> DataFrame:
    """Put every row of ``docs`` into one of ``shards`` contiguous shards of near-equal bytes.

    Rows are ordered by (hash of the text, id), so equal texts are neighbours. The order is dealt over range
    partitions; each partition's total goes into one prefix sum over partitions, and a running sum inside each
    partition gives every row its global byte offset. Cuts lie at equal shares of the total; a row belongs
    where its middle falls. A small group of equal texts on a cut moves to one side as a whole; a large one is
    split, so that one group with a third of all rows still fills several shards evenly.

    Equal texts are ordered by id, rows that agree in both by a number of their own. Very long texts count whole; one
    larger than a shard is in the one where its middle falls. A null text has no bytes and counts ``overhead`` alone; its checksum is that of an empty text. Null and
    repeated ids are rows like any other. An empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    order = ["h", "doc_id", "row"]
    ranged = materialise(slim.repartitionByRange(partitions(docs.sparkSession), *order).withColumn("part", F.spark_partition_id()), "shard-ranges")

    # One row for each range partition: bounded by the number of partitions, whatever the number of documents.
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).select(
        "part",
        F.coalesce(F.sum("bytes").over(by_part), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(by_part), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumns({"upto": F.sum("size").over(inside), "nth": F.row_number().over(inside)}).join(F.broadcast(offsets), "part")
    start = F.col("bytes_before") + F.col("upto") - F.col("size")
    placed = materialise(
        placed.select(
            "doc_id", "size", "text_crc32", "h", start.alias("start"), (F.col("rows_before") + F.col("nth") - 1).alias("position"), "total",
            _shard_at(start, F.col("size"), F.col("total"), shards).alias("cut"),
        ),
        "shard-offsets",
    )

    # At most one group lies across each cut, so these tables have no more rows than there are shards.
    on_cut = placed.groupBy("cut").agg(F.min("h").alias("h")).select("h").distinct()
    moved = (
        placed.join(F.broadcast(on_cut), "h")
        .groupBy("h")
        .agg(F.sum("size").alias("bytes"), F.min("start").alias("first"), F.min("cut").alias("low"), F.max("cut").alias("high"), F.max("total").alias("all"))
        .filter((F.col("low") < F.col("high")) & (F.col("bytes") * shards <= F.col("all") * F.lit(whole_group_share)))
        .select("h", _shard_at(F.col("first"), F.col("bytes"), F.col("all"), shards).alias("whole"))
    )
    sharded = placed.join(F.broadcast(moved), "h", "left").withColumn("shard", F.coalesce("whole", "cut"))
    firsts = sharded.groupBy("shard").agg(F.min("position").alias("first_position"))
    return sharded.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("position") - F.col("first_position")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
