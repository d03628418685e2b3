"""Image folders as pixel tables, and pixel tables as files."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.functions.text import IMAGE_EXTENSIONS, extension, file_name


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images (image_id, width, height, channels, data) of a folder; files that don't decode are left out."""
    raw = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")
    named = raw.filter(extension(F.col("origin")).isin(*IMAGE_EXTENSIONS))
    return named.select(file_name(F.col("origin")).alias("image_id"), "width", "height", F.col("nChannels").alias("channels"), "data")


def unreadable_images(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, error) of the image files of a folder that don't decode."""
    listed = spark.read.format("binaryFile").load(folder).select(file_name(F.col("path")).alias("image_id"))
    return listed.filter(extension(F.col("image_id")).isin(*IMAGE_EXTENSIONS)).join(read_images(spark, folder).select("image_id"), "image_id", "left_anti").withColumn("error", F.lit("UNREADABLE_IMAGE"))


def explode_pixels(images: DataFrame) -> DataFrame:
    """One row for each pixel: grey is repeated over the channels, transparency is laid on white.

    Rows of an image are dealt out first, so one large image is many tasks' work.
    """
    rows = images.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    rows = rows.select("image_id", "width", "channels", "y", F.substring(F.col("data"), F.col("y") * F.col("width") * F.col("channels") + 1, F.col("width") * F.col("channels")).alias("line"))
    pixels = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))

    def byte(k: int) -> Column:
        return F.conv(F.hex(F.substring(F.col("line"), F.col("x") * F.col("channels") + k + 1, F.lit(1))), 16, 10).cast("int")

    alpha = byte(3) / 255.0
    channels = []
    for name, k in (("r", 2), ("g", 1), ("b", 0)):  # the source stores blue first
        over_white = F.round(byte(k) * alpha + 255 * (1 - alpha)).cast("int")
        channels.append(F.when(F.col("channels") == 1, byte(0)).when(F.col("channels") == 4, over_white).otherwise(byte(k)).alias(name))
    return pixels.select("image_id", "x", "y", *channels)


def decimated(pixels: DataFrame, limit: int) -> DataFrame:
    """Every n-th pixel of every n-th row, so that neither side of an image has more than about ``limit``."""
    sides = pixels.groupBy("image_id").agg(F.greatest(F.max("x"), F.max("y")).alias("side"))
    step = F.ceil((F.col("side") + 1) / F.lit(limit))
    return pixels.join(sides.withColumn("step", step), "image_id").filter((F.col("x") % F.col("step") == 0) & (F.col("y") % F.col("step") == 0)).select(*pixels.columns)


def quality_limit(quality: int) -> int:
    """Pixels of the longer side for a quality of 1 to 10."""
    return int(100 + 900 * (max(1, min(10, quality)) - 1) / 9)


def write_pixels(pixels: DataFrame, path: str) -> None:
    pixels.write.mode("overwrite").partitionBy("image_id").parquet(path)


def write_manifest(manifest: DataFrame, path: str, mode: str = "append") -> None:
    """One row for each image: image_id, success, error, elapsed_ms."""
    manifest.select("image_id", "success", "error", "elapsed_ms").write.mode(mode).parquet(path)


def pack_images(pixels: DataFrame) -> DataFrame:
    """Pixels (image_id, x, y, r, g, b) as images (image_id, width, height, channels, data), as :func:`read_images` gives them.

    Rows are packed each for itself, then put together; places without a pixel are black, negative ones are left out.
    An image is one record, as image formats have it.
    """
    blank = F.lit("000000")
    hexed = F.concat(*[F.lpad(F.lower(F.hex(F.col(c).cast("long"))), 2, "0") for c in ("b", "g", "r")])

    def filled(listed: Column, at: str, text: str, gap: Column) -> Column:
        """The texts of a sorted array with as many gaps between them as places are left out."""
        before = lambda i: F.coalesce(F.get(listed, i - 1)[at], F.lit(-1))
        return F.array_join(F.transform(listed, lambda e, i: F.concat(F.repeat(gap, e[at] - F.when(i == 0, -1).otherwise(before(i)) - 1), e[text])), "")

    inside = pixels.filter("x >= 0 AND y >= 0").select("image_id", "x", "y", hexed.alias("bgr"))
    lines = inside.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", "bgr"))).alias("row"))
    lines = lines.select("image_id", "y", F.element_at("row", -1)["x"].alias("last"), filled(F.col("row"), "x", "bgr", blank).alias("line"))
    images = lines.groupBy("image_id").agg((F.max("last") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.sort_array(F.collect_list(F.struct("y", "line"))).alias("rows"))
    whole = F.transform("rows", lambda r: F.struct(r["y"].alias("y"), F.rpad(r["line"], F.col("width") * 6, F.lit("0")).alias("line")))
    data = F.unhex(filled(whole, "y", "line", F.repeat(blank, F.col("width"))))
    return images.select("image_id", F.col("width").cast("int"), F.col("height").cast("int"), F.lit(3).alias("channels"), data.alias("data"))


def bitmap_bytes(width: int, height: int, data: bytes) -> bytes:
    """An uncompressed bitmap file of rows of blue, green and red bytes, the lowest row first and each padded to four bytes."""
    stride, padding = 3 * width, -3 * width % 4
    rows = [data[i * stride : (i + 1) * stride] + bytes(padding) for i in range(height - 1, -1, -1)]
    body = b"".join(rows)
    return struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


class BitmapWriter(DataSourceWriter):
    """Writes each image as a file of its own; a task that runs again replaces its files with the same ones."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, folder = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        system.create_dir(folder, recursive=True)
        for row in iterator:
            name = row.image_id.rsplit(".", 1)[0] if "." in row.image_id else row.image_id
            target = f"{folder}/{name}.bmp"
            part = f"{target}.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                out.write(bitmap_bytes(row.width, row.height, bytes(row.data)))
            system.move(part, target)
        return WriterCommitMessage()


class BitmapSource(DataSource):
    """The format ``bitmaps``: images (image_id, width, height, channels, data) as bitmap files of a folder that executors share."""

    @classmethod
    def name(cls) -> str:
        return "bitmaps"

    def schema(self) -> str:
        return "image_id string, width int, height int, channels int, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BitmapWriter(self.options["path"])


def write_images(pixels: DataFrame, folder: str) -> None:
    """Pixel tables as bitmap files, one for each image, which :func:`read_images` reads back."""
    spark = pixels.sparkSession
    spark.dataSource.register(BitmapSource)
    pack_images(pixels).write.format("bitmaps").mode("append").save(folder)
