"""Rows by where they stand in files, so that what is found out about them comes back to their texts without a shuffle."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import materialise

FILE, PLACE = "file_", "place_"


def bit_position(number: Column) -> Column:
    return F.bitmap_bit_position(number + 1)


def bit_bucket(number: Column) -> Column:
    return F.bitmap_bucket_number(number + 1)


def has_bit(bits: Column, number: Column) -> Column:
    """Whether the bitmap of the number's bucket has it."""
    position = bit_position(number)
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), position % 8)) % 2 == 1


def _of_files(docs: DataFrame) -> DataFrame:
    return docs.withColumns({FILE: F.xxhash64("_metadata.file_path"), PLACE: F.col("_metadata.row_index")})


def placed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the columns FILE and PLACE, which tell its rows apart and are the same each time it is read.

    They are those of its own files. A table that is not read from files, or has several rows from one place there, is
    written first. Files are told apart by hashes; if two were equal, rows would share a place, and so be written.
    """
    try:
        found = _of_files(docs)
        held = found.groupBy(FILE, bit_bucket(F.col(PLACE))).agg(F.count("*").alias("rows"), F.bitmap_count(F.bitmap_construct_agg(bit_position(F.col(PLACE)))).alias("places"))
        if held.filter("rows <> places").isEmpty():
            return found
    except AnalysisException:  # it has no such columns
        pass
    return _of_files(materialise(docs, name))
