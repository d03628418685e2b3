"""Distributions of numeric columns by group: moments, histograms, cumulative shares, quantile and nearest maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.scans import carried, in_ranges, inside

#: Values of a reference in a cell of the grid of shares, and cells at most.
GRID_ROWS, MOST_CELLS = 8, 1 << 24


def channel_moments(df: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Mean, population deviation, least, greatest and count of each channel: one row a group, columns <channel>_<statistic>."""
    aggregates = []
    for c in channels:
        aggregates += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.groupBy(*keys).agg(*aggregates, F.count("*").alias("n"))


def partial_moments(df: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Count, sum and sum of squares of each channel, which add up over parts of a table."""
    aggregates = [F.count("*").alias("n")]
    for c in channels:
        aggregates += [F.sum(c).alias(f"{c}_sum"), F.sum(F.col(c) * F.col(c)).alias(f"{c}_sumsq")]
    return df.groupBy(*keys).agg(*aggregates)


def merge_moments(parts: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Mean and deviation from tables of :func:`partial_moments`; a variance below 0 counts as 0, an empty group as zeros."""
    added = parts.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(f"{c}_{s}").alias(f"{c}_{s}") for c in channels for s in ("sum", "sumsq")])
    columns = []
    for c in channels:
        mean = F.when(F.col("n") > 0, F.col(f"{c}_sum") / F.col("n")).otherwise(0.0)
        square = F.when(F.col("n") > 0, F.col(f"{c}_sumsq") / F.col("n")).otherwise(0.0)
        columns += [mean.alias(f"{c}_mean"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias(f"{c}_std")]
    return added.select(*keys, "n", *columns)


def histogram(df: DataFrame, key: str, value: str, bins: int = 256) -> DataFrame:
    """Rows of each whole bin 0..bins-1 of each group, empty bins included."""
    counted = df.groupBy(key, F.col(value).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = counted.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counted, [key, "bin"], "left").select(key, "bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"))


def channel_counts(df: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Rows of each distinct value of each channel (keys, channel, value, n), all in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in channels])).alias("v")
    return df.select(*keys, each).groupBy(*keys, "v.channel", "v.value").agg(F.count("*").alias("n"))


def cumulative(counts: DataFrame, key: str, by: str) -> DataFrame:
    """Inclusive cumulative share of n; a group without rows has 0. The window runs over bins, never over rows of data."""
    upto = Window.partitionBy(key).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(Window.partitionBy(key))
    return counts.withColumn("cdf", F.when(total > 0, F.sum("n").over(upto) / total).otherwise(0.0))


def nearest_cdf_table(content: DataFrame, reference: DataFrame) -> DataFrame:
    """For each bin of each content group (image_id, bin, cdf): the reference bin (bin, cdf) of nearest share, the lowest if several.

    The nearest share stands just at or after the content's share in order, or just before it: both come from windows
    over the union of the two tables of bins.
    """
    ends = reference.groupBy("cdf").agg(F.min("bin").alias("bin"))
    both = content.select("image_id", "bin", "cdf", F.lit(None).cast("int").alias("to"), F.lit(1).alias("asks"))
    groups = content.select("image_id").distinct()
    offers = groups.withColumn("one", F.lit(1)).join(F.broadcast(ends.withColumn("one", F.lit(1))), "one").select("image_id", F.lit(None).cast("int").alias("bin"), "cdf", F.col("bin").alias("to"), F.lit(0).alias("asks"))
    offer = F.when(F.col("asks") == 0, F.struct("cdf", "to"))
    ahead = Window.partitionBy("image_id").orderBy("cdf", "asks")
    below = F.last(offer, ignorenulls=True).over(ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The same from the other end: a frame that ends at the current row costs one pass, one that begins there does not.
    behind = Window.partitionBy("image_id").orderBy(F.desc("cdf"), F.desc("asks"))
    above = F.last(offer, ignorenulls=True).over(behind.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = both.unionByName(offers).withColumns({"below": below, "above": above}).filter("asks = 1")
    lower = F.col("above").isNull() | ((F.col("cdf") - F.col("below.cdf")) < (F.col("above.cdf") - F.col("cdf"))) | (
        ((F.col("cdf") - F.col("below.cdf")) == (F.col("above.cdf") - F.col("cdf"))) & (F.col("below.to") <= F.col("above.to"))
    )
    return met.select("image_id", "bin", F.when(F.col("below").isNotNull() & lower, F.col("below.to")).otherwise(F.col("above.to")).alias("mapped"))


def running_totals(counts: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Counts (keys, by, n) with upto (n of all rows of the group up to this one), total and the value before, if any.

    The counts are dealt over Spark's range partitions and written once; what stands before a partition comes from the
    sums of partitions. So neither a group nor a table without keys is one task's work, whatever its size.
    """
    return totals_in_ranges(in_ranges(counts.select(*keys, by, "n"), [*keys, by], "counts"), keys, by)


def totals_in_ranges(ranged: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """:func:`running_totals` of counts that are dealt over ranges of (keys, by) already."""
    ranged = carried(ranged, keys, {"earlier": (F.sum("n"), F.sum), "last": (F.max(by), F.max)}, whole={"total": (F.sum("n"), F.sum)})
    upto = F.sum("n").over(inside(keys, [by]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = ranged.withColumns({"upto": F.coalesce("earlier", F.lit(0)) + upto, "before": F.coalesce(F.lag(by).over(inside(keys, [by])), "last")})
    return counted.select(*keys, by, "n", "upto", "total", "before")


def quantile_map(content: DataFrame, reference: DataFrame, n_reference: int, on: Sequence[str] = ()) -> DataFrame:
    """For each content value (key columns, value, cdf): the reference's value at that share, linearly between neighbours.

    ``reference`` is a table of :func:`running_totals` over its ``n_reference`` distinct values, called value; rows of
    the two meet where the columns ``on`` agree. Each of them answers for the shares from the one before, exclusive, to its own; they are laid on a grid of shares of about
    GRID_ROWS values a cell, on which the two tables meet.
    """
    cells = max(1, min(MOST_CELLS, n_reference // GRID_ROWS))
    cell = lambda share: F.least(F.lit(cells - 1), F.floor(share * cells)).cast("int")
    answers = reference.select(
        *on, F.col("value").cast("double").alias("high"), F.col("before").cast("double").alias("low"), ((F.col("upto") - F.col("n")) / F.col("total")).alias("over"), (F.col("upto") / F.col("total")).alias("most"),
    )
    answers = answers.withColumn("cell", F.explode(F.sequence(cell(F.col("over")), cell(F.col("most")))))
    met = content.withColumn("cell", cell(F.col("cdf"))).join(answers, [*on, "cell"]).filter((F.col("over") < F.col("cdf")) & (F.col("cdf") <= F.col("most")))
    between = F.col("low") + (F.col("high") - F.col("low")) * ((F.col("cdf") - F.col("over")) / (F.col("most") - F.col("over")))
    mapped = F.when(F.col("low").isNull() | (F.col("most") == F.col("cdf")), F.col("high")).otherwise(between)
    return met.select(*[c for c in content.columns if c != "cdf"], mapped.alias("mapped"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(keys, q0, q1, ...): interpolated quantiles of each group, from running totals of its distinct values."""
    counts = value_counts(df.filter(F.col(value).isNotNull()), keys, value)
    totals = running_totals(counts, keys, value)
    place = [F.lit(p) * (F.col("total") - 1) for p in shares]
    at = lambda i: F.max(F.when((F.col("upto") - F.col("n") <= i) & (i < F.col("upto")), F.col(value)))
    ends = [f for i, p in enumerate(place) for f in (at(F.floor(p)).alias(f"lo{i}"), at(F.ceil(p)).alias(f"hi{i}"), F.max(p - F.floor(p)).alias(f"part{i}"))]
    found = totals.groupBy(*keys).agg(*ends)
    return found.select(*keys, *[(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"part{i}")).alias(f"q{i}") for i in range(len(shares))])


def exclusive_offsets(counts: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """What stands before each row of counts in its group."""
    before = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))


def position_in(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: int = 64) -> DataFrame:
    """The number of each row in its group. Rows are numbered in blocks of ``block`` values of the first order column, a number."""
    cut = df.withColumn("block_", F.floor(F.col(order[0]) / block))
    sizes = exclusive_offsets(cut.groupBy(*keys, "block_").agg(F.count("*").alias("n")), keys, "block_").drop("n")
    nth = F.row_number().over(Window.partitionBy(*keys, "block_").orderBy(*order))
    return cut.withColumn("nth_", nth).join(sizes, [*keys, "block_"]).select(*df.columns, (F.col("offset") + F.col("nth_")).cast("int").alias("position"))


def weighted_share(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)
