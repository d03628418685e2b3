"""Parameters of the palette pipeline: defaults, limits, and their JSON form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import schemas

# Default, least and greatest value of each parameter, and its type.
LIMITS = {
    "num_colors": (8, 2, 256, "int"),
    "quality": (5, 1, 10, "int"),
    "hue_weight": (3.0, 0.1, 10.0, "double"),
    "saturation_weight": (1.0, 0.1, 5.0, "double"),
    "value_weight": (1.0, 0.1, 5.0, "double"),
    "dithering_strength": (8.0, 0.0, 16.0, "double"),
    "extremes_threshold": (10, 0, 50, "int"),
    "edge_blur_radius": (1.5, 0.0, 5.0, "double"),
    "edge_blur_strength": (0.3, 0.0, 1.0, "double"),
    "edge_detection_threshold": (25, 0, 200, "int"),
    "gpu_batch_size": (2_000_000, 100_000, 10_000_000, "int"),
}


def limited(name: str, value: Column) -> Column:
    """The value, or the default for null, within the limits of the parameter."""
    default, low, high, kind = LIMITS[name]
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value.cast(kind), F.lit(default)))).cast(kind)


def settings(text: Column) -> Column:
    """All parameters from a JSON object, as a struct; what is absent or malformed has its default."""
    schema = ", ".join(f"{n} {kind}" for n, (*_, kind) in LIMITS.items())
    given = F.from_json(text, schema)
    return F.struct(*[limited(n, given[n]).alias(n) for n in LIMITS])


def focus_ranges(text: Column) -> Column:
    """Focus ranges from a JSON list; null if it is malformed or no list."""
    return F.when(text.rlike(r"^\s*\["), F.from_json(text, schemas.FOCUS_RANGES))


def weights(text: Column) -> Column:
    """Weights by channel from a JSON object; null if malformed."""
    return F.from_json(text, "map<string,double>")


def steps(text: Column) -> Column:
    """The steps of a pipeline from a JSON list of objects with a method and params; null if malformed or no list."""
    return F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<struct<method:string,params:map<string,string>>>"))
