"""Tables that the operators take, and checks that a frame is one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "doubles": T.ArrayType(T.DoubleType()), "texts": T.MapType(T.StringType(), T.StringType()),
}


def _table(**columns: str) -> T.StructType:
    """A struct by names of kinds; needs no session, unlike parsing DDL."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in columns.items()])


PIXELS = _table(image_id="string", x="int", y="int", r="int", g="int", b="int")
METRICS = _table(ts="timestamp", operation="string", duration_ms="double", memory_mb="double", cpu_percent="double", algorithm_id="string", request_id="string", success="boolean", metadata="texts")
LOG = _table(
    timestamp="string", level="string", logger="string", message="string", module="string", function="string", line="int", request_id="string", operation_id="string",
    algorithm_id="string", user_session="string", duration_ms="double", performance_data="string", exception="string", _corrupt_record="string",
)
BENCHMARK = _table(timestamp="timestamp", device="string", radius="int", elapsed_ms="double", width="int", height="int")
FOCUS_RANGES = T.ArrayType(_table(target_hsv="doubles", range_h="double", range_s="double", range_v="double", boost_factor="double"))
PIPELINE = T.ArrayType(_table(method="string", params="texts"))
PARAMETERS = _table(k="int")


def validate(df: DataFrame, schema: T.StructType) -> list[str]:
    """What keeps ``df`` from being a table of ``schema``: every missing or differently typed column; empty if nothing."""
    kinds = dict(df.dtypes)
    return [
        f"{f.name}: {'missing' if f.name not in kinds else f'is {kinds[f.name]}, not {f.dataType.simpleString()}'}"
        for f in schema.fields
        if kinds.get(f.name) != f.dataType.simpleString()
    ]


def require(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` itself, or one error with every message of :func:`validate`."""
    if wrong := validate(df, schema):
        raise ValueError("; ".join(wrong))
    return df
