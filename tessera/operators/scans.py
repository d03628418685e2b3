"""Running values over an order, across Spark's own range partitions.

A table is dealt over range partitions by its order and written once. What a partition adds up to is one row for each
key in it; a window over those rows tells what stands before, or behind, a partition, and each partition only has to
look at its own rows. So a key with a third of all rows, or a table without keys, is the work of many tasks, and there
are as many ranges as the shuffle of the table has partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.sources.folders import written

#: The number of the range that a row lies in, ascending with the order.
PART = "part_"


def in_ranges(df: DataFrame, order: Sequence[str | Column], name: str = "ranges") -> DataFrame:
    """``df`` dealt over ranges of ``order``, with their number, as a written table."""
    return written(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), name)


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """A join on keys of which null is a value like any other."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right.withColumnsRenamed({k: f"{k}_right_" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"{k}_right_")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"{k}_right_" for k in keys])


def carried(ranged: DataFrame, keys: Sequence[str], totals: dict[str, tuple[Column, Callable[[Column], Column]]], behind: bool = False, whole: dict[str, tuple[Column, Callable[[Column], Column]]] | None = None) -> DataFrame:
    """``ranged`` with what the earlier ranges (or those behind) of its key come to, null where there are none.

    ``totals`` has for each new column what a range comes to, an aggregate, and what several do, another; ``whole`` has
    the same for columns over all ranges of the key.
    """
    whole = whole or {}
    of_part = ranged.groupBy(*keys, PART).agg(*[of.alias(name) for name, (of, _) in (totals | whole).items()])
    by = Window.partitionBy(*keys).orderBy(F.desc(PART) if behind else PART).rowsBetween(Window.unboundedPreceding, -1)
    over = [combined(F.col(name)).over(by).alias(name) for name, (_, combined) in totals.items()]
    over += [combined(F.col(name)).over(Window.partitionBy(*keys)).alias(name) for name, (_, combined) in whole.items()]
    return join_keys(ranged, of_part.select(*keys, PART, *over), [*keys, PART])


def inside(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    """The rows of a key in one range, in order."""
    return Window.partitionBy(PART, *keys).orderBy(*order)
