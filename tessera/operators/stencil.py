"""Neighbourhood operators on tables (image_id, x, y, v): windows over rows, then over columns, never a whole image at once."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _row():
    return Window.partitionBy("image_id", "y").orderBy("x")


def _column():
    return Window.partitionBy("image_id", "x").orderBy("y")


def _beside(v: str, k: int, window, border: str = "clamp") -> Column:
    """The value k places on (before, if negative). Beyond the border: the border's own value, which for k = 1 is its reflection."""
    if k == 0:
        return F.col(v)
    there = F.lag(v, -k) if k < 0 else F.lead(v, k)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = F.first(v).over(whole) if k < 0 else F.last(v).over(whole)
    if border == "reflect":
        # The i-th row from the border looks 2 i - 1 rows less far over it, and back: one fixed offset for each i.
        nth = F.row_number().over(window)
        from_border = nth if k < 0 else F.count("*").over(whole) - nth + 1
        far = F.last(v).over(whole) if k < 0 else F.first(v).over(whole)
        for i in range(abs(k), 0, -1):
            back = abs(k) - 2 * i + 1
            mirrored = F.col(v) if back == 0 else (F.lead(v, back) if k < 0 else F.lag(v, back)).over(window)
            edge = F.when(from_border == i, F.coalesce(mirrored, far)).otherwise(edge)
    elif border != "clamp":
        raise ValueError(f"unknown border {border!r}; known: clamp, reflect")
    return F.coalesce(there.over(window), edge)


def _around(df: DataFrame, fields: Sequence[str], reach: int, window) -> DataFrame:
    """Columns of what stands up to ``reach`` places before (b1, b2, ...) and behind (a1, a2, ...) of the structs v of ``fields``.

    Each is one window for all fields. With them come what :func:`_placed` needs of the border.
    """
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    there = {f"{name}{m}": f("v", m).over(window) for name, f in (("b", F.lag), ("a", F.lead)) for m in range(1, reach + 1)}
    border = {"first_": F.first("v").over(whole), "last_": F.last("v").over(whole), "nth_": F.row_number().over(window), "all_": F.count("*").over(whole)}
    places = [*[f"b{m}" for m in range(reach, 0, -1)], "v", *[f"a{m}" for m in range(1, reach + 1)]]
    return df.withColumns(there | border).withColumns({f"line_{f}": F.array(*[F.col(p)[f] for p in places]) for f in fields})


def _placed(f: str, k: int, reach: int, border: str = "clamp") -> Column:
    """:func:`_beside` of a field f of v, from the columns of :func:`_around`."""
    if k == 0:
        return F.col("v")[f]
    m, near, far = abs(k), *(("first_", "last_") if k < 0 else ("last_", "first_"))
    edge = F.col(near)[f]
    if border == "reflect":
        i = F.col("nth_") if k < 0 else F.col("all_") - F.col("nth_") + 1
        back = (m + 1 - 2 * i) * (1 if k < 0 else -1)
        edge = F.when(i <= m, F.coalesce(F.get(F.col(f"line_{f}"), (back + reach).cast("int")), F.col(far)[f])).otherwise(edge)
    return F.coalesce(F.col(f"{'b' if k < 0 else 'a'}{m}")[f], edge)


def blurred_with_gradient(df: DataFrame, channels: Sequence[str], grey: str, sigma: float) -> DataFrame:
    """Each channel with its blur, ``blur_<channel>``, over reflected borders, and the Sobel magnitude of ``grey``, gradient.

    The same values as :func:`gaussian_blur` of each channel and :func:`gradient` give, in one pass over rows and one over columns.
    """
    radius = int(4 * sigma + 0.5)
    reach, weights = max(1, radius), gaussian_weights(sigma, radius) if radius else [1.0]
    total = lambda f: sum((F.lit(w) * _placed(f, k - radius, reach, "reflect") for k, w in enumerate(weights)), F.lit(0.0))
    places = ["image_id", "x", "y"]
    v = df.select(*places, F.struct(*[F.col(c).cast("double").alias(c) for c in channels], F.col(grey).cast("double").alias("g_")).alias("v"))
    rows = _around(v, channels, reach, _row())
    sums = [total(c).alias(c) for c in channels] + [_placed("g_", i - 1, reach).alias(f"h{i}") for i in range(3)]
    rows = rows.select(*places, F.col("v").alias("own"), F.struct(*sums).alias("v"))
    columns = _around(rows, channels, reach, _column())
    n = {f"n{j}{i}": _placed(f"h{i}", j - 1, reach) for i in range(3) for j in range(3)}
    return columns.select(*places, "own", *[total(c).alias(f"blur_{c}") for c in channels], *[v.alias(k) for k, v in n.items()]).select(
        *places, *[F.col("own")[c].alias(c) for c in channels], *[f"blur_{c}" for c in channels], _sobel().alias("gradient")
    )


def medians3(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """:func:`median3` of each channel, in one pass over rows and one over columns."""
    v = df.select("image_id", "x", "y", F.struct(*[F.col(c).cast("double").alias(c) for c in channels]).alias("v"))
    rows = _around(v, [], 1, _row()).select("image_id", "x", "y", F.struct(*[_placed(c, i - 1, 1).alias(f"{c}{i}") for c in channels for i in range(3)]).alias("v"))
    columns = _around(rows, [], 1, _column())
    middle = lambda c: F.get(F.array_sort(F.array(*[_placed(f"{c}{i}", j - 1, 1) for i in range(3) for j in range(3)])), F.lit(4))
    return columns.select("image_id", "x", "y", *[middle(c).alias(c) for c in channels])


def _nine(df: DataFrame) -> DataFrame:
    """Columns n<row><column> of the 3 x 3 neighbourhood."""
    wide = df.withColumns({f"h{i}": _beside("v", i - 1, _row()) for i in range(3)})
    return wide.withColumns({f"n{j}{i}": _beside(f"h{i}", j - 1, _column()) for i in range(3) for j in range(3)})


def _sobel() -> Column:
    n = {f"{j}{i}": F.col(f"n{j}{i}") for i in range(3) for j in range(3)}
    across = (n["02"] + 2 * n["12"] + n["22"]) - (n["00"] + 2 * n["10"] + n["20"])
    down = (n["20"] + 2 * n["21"] + n["22"]) - (n["00"] + 2 * n["01"] + n["02"])
    return F.sqrt(across**2 + down**2)


def gradient(df: DataFrame) -> DataFrame:
    """Sobel magnitude with reflected borders."""
    return _nine(df).select(*df.columns, _sobel().alias("gradient"))


def median3(df: DataFrame) -> DataFrame:
    middle = F.get(F.array_sort(F.array(*[f"n{j}{i}" for i in range(3) for j in range(3)])), F.lit(4))
    return _nine(df).select("image_id", "x", "y", middle.alias("median"))


def gaussian_weights(sigma: float, radius: int) -> list[float]:
    raw = [exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def gaussian_blur(df: DataFrame, sigma: float, radius: int | None = None, border: str = "clamp") -> DataFrame:
    """Two passes of weighted neighbours; the radius is int(4 sigma + 0.5) unless given."""
    radius = int(4 * sigma + 0.5) if radius is None else radius
    weights = gaussian_weights(sigma, radius)
    total = lambda v, window: sum((F.lit(w) * _beside(v, k - radius, window, border) for k, w in enumerate(weights)), F.lit(0.0))
    return df.withColumn("across", total("v", _row())).withColumn("blur", total("across", _column())).drop("across")


def reached(marked: DataFrame, steps: int) -> DataFrame:
    """Places within ``steps`` moves along rows and columns of a marked place, each once, whether there is a row or not."""
    offsets = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-steps, steps + 1) for j in range(-steps, steps + 1) if abs(i) + abs(j) <= steps])
    moved = marked.select("image_id", "x", "y", F.explode(offsets).alias("o"))
    return moved.select("image_id", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y")).distinct()


def dilate(marked: DataFrame, grid: DataFrame, steps: int) -> DataFrame:
    """Places of the grid within ``steps`` moves along rows and columns of a marked place."""
    return grid.select("image_id", "x", "y").join(reached(marked, steps), ["image_id", "x", "y"], "left_semi")


def edge_blend(df: DataFrame, threshold: float, steps: int, sigma: float, radius: int, strength: float) -> DataFrame:
    """The blurred value blended in by ``strength`` around edges, the value itself elsewhere."""
    near = dilate(gradient(df).filter(F.col("gradient") > threshold), df, steps).withColumn("near", F.lit(True))
    blurred = gaussian_blur(df, sigma, radius).join(near, ["image_id", "x", "y"], "left")
    return blurred.select("image_id", "x", "y", F.when(F.col("near"), F.col("v") * (1 - strength) + F.col("blur") * strength).otherwise(F.col("v")).alias("v"))
