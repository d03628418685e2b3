"""Pixel tables derived from the given tables, for Spark and, as the same text, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import color

CHANNELS = ("L", "a", "b")

PIXELS_SQL = """pixels AS (
 SELECT concat('img', CAST(o_orderkey % 4 AS VARCHAR)) AS image_id, CAST(floor(o_orderkey / 4) AS INT) % 64 AS x,
        CAST(floor(floor(o_orderkey / 4) / 64) AS INT) AS y, CAST((o_custkey * 37) % 256 AS INT) AS r,
        CAST(CAST(floor(o_totalprice) AS BIGINT) % 256 AS INT) AS g, CAST((o_orderkey * 91) % 256 AS INT) AS b FROM orders)"""


def lab_sql(r: str, g: str, b: str) -> tuple[str, str, str]:
    """CIELAB of an sRGB colour as DuckDB expressions."""
    lin = [f"(CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4::DOUBLE) END)" for c in (r, g, b)]
    f = []
    for row, w in zip(color.RGB_TO_XYZ, color.WHITE, strict=True):
        t = "((" + " + ".join(f"{k}::DOUBLE * {c}" for k, c in zip(row, lin, strict=True)) + f") / {w}::DOUBLE)"
        f.append(f"(CASE WHEN {t} > {(6 / 29) ** 3!r}::DOUBLE THEN cbrt({t}) ELSE {t} / {3 * (6 / 29) ** 2!r}::DOUBLE + {4 / 29!r}::DOUBLE END)")
    return f"(116 * {f[1]} - 16)", f"(500 * ({f[0]} - {f[1]}))", f"(200 * ({f[1]} - {f[2]}))"


_L, _A, _B = lab_sql("r", "g", "b")
LAB_SQL = PIXELS_SQL + f""", labs AS (SELECT image_id, x, y, r, g, b AS bl, {_L} AS L, {_A} AS a, {_B} AS b FROM pixels),
content AS (SELECT image_id, x, y, L, a, b FROM labs WHERE image_id <> 'img3'),
reference AS (SELECT image_id, x, y, L, a, b FROM labs WHERE image_id = 'img3')"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.floor(F.col("o_orderkey") / 4)
    return orders.select(
        F.concat(F.lit("img"), (F.col("o_orderkey") % 4).cast("string")).alias("image_id"),
        (k % 64).cast("int").alias("x"),
        F.floor(k / 64).cast("int").alias("y"),
        ((F.col("o_custkey") * 37) % 256).cast("int").alias("r"),
        (F.floor("o_totalprice") % 256).cast("int").alias("g"),
        ((F.col("o_orderkey") * 91) % 256).cast("int").alias("b"),
    )


def labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("image_id", "x", "y", color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")).alias("lab")).select("image_id", "x", "y", "lab.*")


def content_and_reference(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    both = labs(spark, sf_dir)
    return both.filter("image_id <> 'img3'"), both.filter("image_id = 'img3'")


#: Content and the reference restated as rows at the same places: images 0 and 1 make one pair, 2 and 3 another.
PAIRS_SQL = LAB_SQL + """, left_ AS (SELECT CASE image_id WHEN 'img0' THEN 'p0' ELSE 'p1' END AS image_id, x, y, L, a, b FROM labs WHERE image_id IN ('img0', 'img2')),
right_ AS (SELECT CASE image_id WHEN 'img1' THEN 'p0' ELSE 'p1' END AS image_id, x, y, L, a, b FROM labs WHERE image_id IN ('img1', 'img3'))"""


def pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    named = labs(spark, sf_dir).withColumn("side", F.col("image_id").isin("img1", "img3")).withColumn("image_id", F.when(F.col("image_id").isin("img0", "img1"), "p0").otherwise("p1"))
    return named.filter(~F.col("side")).drop("side"), named.filter("side").drop("side")


MASK_SQL = ", mask AS (SELECT image_id, x, y, CASE (x + y) % 3 WHEN 0 THEN 1.0 ELSE 0.5 END AS m FROM {} WHERE (x + y) % 3 < 2)"


def mask(df: DataFrame) -> DataFrame:
    at = (F.col("x") + F.col("y")) % 3
    return df.filter(at < 2).select("image_id", "x", "y", F.when(at == 0, 1.0).otherwise(0.5).alias("m"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Columns rounded; a negative zero is 0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


def rounded_sql(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)
