"""How well a transfer did: differences, correlations, gates and diagnoses, one row for each image."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import color
from tessera.operators.difference import with_delta_e2000

LAB = ("L", "a", "b")
ON = ("image_id", "x", "y")


def _aligned(result: DataFrame, reference: DataFrame, channels=LAB) -> DataFrame:
    return result.join(reference.select(*ON, *[F.col(c).alias(f"o_{c}") for c in channels]), list(ON))


def _with_difference(df: DataFrame) -> DataFrame:
    return with_delta_e2000(df, LAB, [f"o_{c}" for c in LAB], "de")


def report(result: DataFrame, reference: DataFrame) -> DataFrame:
    """Mean and greatest CIEDE2000, and by channel correlation and differences of mean and deviation."""
    aggregates = [F.round(F.avg("de"), 4).alias("mean_delta_e"), F.round(F.max("de"), 4).alias("max_delta_e")]
    for c in LAB:
        o = f"o_{c}"
        aggregates += [
            F.round(F.corr(c, o), 4).alias(f"corr_{c}"),
            F.round(F.abs(F.avg(c) - F.avg(o)), 4).alias(f"mean_diff_{c}"),
            F.round(F.abs(F.stddev_pop(c) - F.stddev_pop(o)), 4).alias(f"std_diff_{c}"),
        ]
    return _with_difference(_aligned(result, reference)).groupBy("image_id").agg(*aggregates)


def gate(reports: DataFrame, most_delta_e: float = 50.0, least_correlation: float = 0.5) -> DataFrame:
    failed = F.col("mean_delta_e") > most_delta_e
    for c in LAB:
        failed = failed | (F.col(f"corr_{c}") < least_correlation)
    return reports.withColumn("passed", ~failed)


def diagnose(content: DataFrame, result: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """Issues, warnings and suggestions for each image, from the change between content and result.

    With ``target``, rows at the same places, a result that is everywhere within 5 of it is a warning.
    """
    within = lambda p, q, most: reduce(Column.__and__, [F.abs(F.col(p + c) - F.col(q + c)) <= most for c in LAB])
    full = _with_difference(_aligned(content, result))
    if target is None:
        full = full.withColumn("over", F.lit(False))
    else:
        full = full.join(target.select(*ON, *[F.col(c).alias(f"t_{c}") for c in LAB]), list(ON)).withColumn("over", within("o_", "t_", 5))
    s = full.withColumn("same", within("", "o_", 1)).groupBy("image_id").agg(
        F.avg("de").alias("m"), F.max("de").alias("x"), F.corr("L", "o_L").alias("c"), F.bool_and("same").alias("same"), F.bool_and("over").alias("over")
    )
    m, x, c = F.col("m"), F.col("x"), F.col("c")
    rules = [
        ("issues", F.col("same"), "no effect", "raise the weights"),
        ("warnings", F.col("over"), "result very similar to target", "lower the weights"),
        ("issues", m > 50, "mean difference very large", "lower the weights"),
        ("issues", x > 100, "largest difference very large", "limit the transfer to a mask"),
        ("issues", c < 0.7, "structure lost", "transfer a and b only"),
        ("warnings", m < 2, "hardly any change", "raise the weights"),
        ("warnings", (c >= 0.7) & (c < 0.85), "structure weakened", "lower the weight of L"),
    ]
    listed = lambda kind, at: F.array_distinct(F.array_compact(F.array(*[F.when(r[1], F.lit(r[at])) for r in rules if kind in (r[0], "all")])))
    return s.select("image_id", listed("issues", 2).alias("issues"), listed("warnings", 2).alias("warnings"), listed("all", 3).alias("suggestions"))


def diagnose_conversion(pixels: DataFrame) -> DataFrame:
    """Colours whose CIELAB is out of range, and whether RGB comes back: mean error over 5 or greatest over 20."""
    there = pixels.withColumn("lab", color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")))
    back = there.withColumn("rgb", color.lab_to_rgb(F.col("lab.L"), F.col("lab.a"), F.col("lab.b")))
    error = sum((F.abs(F.col(c) - F.col(f"rgb.{c}")) for c in "rgb"), F.lit(0)) / 3.0
    out = (F.col("lab.L") < 0) | (F.col("lab.L") > 100.0001)
    for c in ("a", "b"):
        out = out | (F.col(f"lab.{c}") < -128) | (F.col(f"lab.{c}") > 127)
    return back.groupBy("image_id").agg(F.count("*").alias("n"), F.count_if(out).alias("out_of_range"), ((F.avg(error) > 5) | (F.max(error) > 20)).alias("round_trip_off"))


def validate_catalogue(pixels: DataFrame) -> DataFrame:
    """White border, contrast and moderate saturation of catalogue images; contrast and saturation decide."""
    ends = pixels.groupBy("image_id").agg(F.max("x").alias("ex"), F.max("y").alias("ey"))
    rgb = [F.col(c) for c in "rgb"]
    p = pixels.join(ends, "image_id").select(
        "image_id", ((F.col("r") + F.col("g") + F.col("b")) / 3.0).alias("grey"), color.luma(*rgb).alias("luma"), color.rgb_to_hsv(*rgb)["s"].alias("s"),
        ((F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("ex")) | (F.col("y") == F.col("ey"))).alias("edge"),
    )
    white = (F.avg(F.when(F.col("edge"), F.col("grey"))) > 240).alias("white_background")
    checked = p.groupBy("image_id").agg(white, (F.stddev_pop("luma") > 30).alias("contrast"), ((F.avg("s") > 0.1) & (F.avg("s") < 0.8)).alias("saturation"))
    return checked.withColumn("passed", F.col("contrast") & F.col("saturation"))


def overall_correlation(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row ``r``: the correlation of all channel values at the same places."""
    values = F.explode(F.array(*[F.struct(F.col(c).alias("v"), F.col(f"o_{c}").alias("o")) for c in LAB])).alias("p")
    return _aligned(left, right).select(values).agg(F.corr("p.v", "p.o").alias("r"))


def colour_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    d = sum((F.pow(F.col(c) - F.col(f"o_{c}"), F.lit(2.0)) for c in "rgb"), F.lit(0.0))
    return _aligned(left, right, "rgb").groupBy("image_id").agg(F.round(F.avg(F.sqrt(d)), 4).alias("colour_difference"))


def colour_variance(pixels: DataFrame) -> DataFrame:
    """The variance of all channel values of each image, from sums, so that nothing is repeated for a channel."""
    n, total = 3 * F.count("*"), sum((F.sum(F.col(c).cast("double")) for c in "rgb"), F.lit(0.0))
    squares = sum((F.sum(F.col(c).cast("double") * F.col(c)) for c in "rgb"), F.lit(0.0))
    return pixels.groupBy("image_id").agg((squares / n - (total / n) * (total / n)).alias("variance"))
