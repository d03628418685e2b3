"""Distribution transfer: give numeric columns of one table the distribution of another's, by group, mask, zone or tile.

``content`` is changed; ``reference`` supplies the distribution. Statistics are one row a group and are joined back;
content rows are never shuffled by an operator that needs statistics alone unless their table is large.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import color
from tessera.operators.difference import with_delta_e2000
from tessera.operators.distribution import channel_counts, exact_quantiles, quantile_map, running_totals, totals_in_ranges
from tessera.operators.scans import in_ranges
from tessera.sources.folders import written

LAB = ("L", "a", "b")
#: A deviation under which a channel is only shifted.
FLAT = 1e-6


def moments(df: DataFrame, keys: Sequence[str], channels: Sequence[str], prefix: str, where: Column | None = None) -> DataFrame:
    """<prefix>_m_<channel> and <prefix>_s_<channel> by group, over all rows or those that meet a condition."""
    pick = (lambda c: F.when(where, F.col(c))) if where is not None else F.col
    return df.groupBy(*keys).agg(*[f(pick(c)).alias(f"{prefix}_{s}_{c}") for c in channels for s, f in (("m", F.avg), ("s", F.stddev_pop))])


def moved(c: str) -> Column:
    """A channel with content moments (c_) restated to reference moments (r_)."""
    v, mc, sc, mr, sr = (F.col(n) for n in (c, f"c_m_{c}", f"c_s_{c}", f"r_m_{c}", f"r_s_{c}"))
    return F.when(mr.isNull() | mc.isNull(), v).when(sc < FLAT, v + mr - mc).otherwise((v - mc) * sr / sc + mr)


def _with_statistics(content: DataFrame, reference: DataFrame, channels: Sequence[str], keys: Sequence[str], shared: Sequence[str] = (), mask: Column | None = None) -> DataFrame:
    """Content rows with c_ moments of their own group and r_ moments of the reference (by ``shared`` columns, if any)."""
    own = moments(content, [*keys, *shared], channels, "c", mask)
    joined = content.join(own, [*keys, *shared]) if [*keys, *shared] else content.join(F.broadcast(own))
    ref = moments(reference, list(shared), channels, "r")
    return joined.join(ref, list(shared), "left") if shared else joined.join(F.broadcast(ref))


def _result(df: DataFrame, content: DataFrame, channels: Sequence[str], new: Callable[[str], Column]) -> DataFrame:
    return df.select(*[new(c).alias(c) if c in channels else F.col(c) for c in content.columns])


def moment_transfer(content: DataFrame, reference: DataFrame, channels: Sequence[str] = LAB, keys: Sequence[str] = ("image_id",), shared: Sequence[str] = ()) -> DataFrame:
    """Each channel gets the reference's mean and deviation; a flat one is shifted. Channels left out stay as they are."""
    return _result(_with_statistics(content, reference, channels, keys, shared), content, channels, moved)


def masked_transfer(content: DataFrame, reference: DataFrame, mask: DataFrame, channels: Sequence[str] = ("a", "b"), on: Sequence[str] = ("image_id", "x", "y")) -> DataFrame:
    """Moments of content where the mask (m in 0..1) is over a half; the change is blended in by m; no mask row means 0."""
    with_mask = content.join(mask.select(*on, "m"), list(on), "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    full = _with_statistics(with_mask, reference, channels, ["image_id"], mask=F.col("m") > 0.5)
    return _result(full, content, channels, lambda c: color.lerp(F.col(c), moved(c), F.col("m")))


def aligned(content: DataFrame, other: DataFrame, channels: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Rows that stand at the same place in both tables; the other's channels are o_<channel>."""
    return content.join(other.select(*on, *[F.col(c).alias(f"o_{c}") for c in channels]), list(on))


def same_shape(content: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: whether every place of either table is in the other."""
    both = content.select(*on, F.lit(1).alias("c")).join(other.select(*on, F.lit(1).alias("o")), list(on), "full")
    return both.agg((F.count_if(F.col("c").isNull() | F.col("o").isNull()) == 0).alias("same_shape"))


def pixel_lerp(content: DataFrame, other: DataFrame, weights: Mapping[str, float], on: Sequence[str] = ("image_id", "x", "y")) -> DataFrame:
    """Linear blend of rows at the same place, by channel weight of the other."""
    full = aligned(content, other, list(weights), on)
    return _result(full, content, list(weights), lambda c: color.lerp(F.col(c), F.col(f"o_{c}"), weights[c]))


def masked_lerp(content: DataFrame, other: DataFrame, mask: DataFrame, blend: float, channels: Sequence[str] = LAB, on: Sequence[str] = ("image_id", "x", "y")) -> DataFrame:
    """Blend of rows at the same place, only where the mask is over 0."""
    full = aligned(content, other, channels, on).join(mask.select(*on, "m"), list(on), "left")
    return _result(full, content, channels, lambda c: F.when(F.col("m") > 0, color.lerp(F.col(c), F.col(f"o_{c}"), blend)).otherwise(F.col(c)))


def moment_blend(content: DataFrame, reference: DataFrame, weight: float, channels: Sequence[str] = LAB, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Transfer to moments between content's and the reference's."""
    full = _with_statistics(content, reference, channels, keys)

    def new(c: str) -> Column:
        mc, sc = F.col(f"c_m_{c}"), F.col(f"c_s_{c}")
        m, s = color.lerp(mc, F.col(f"r_m_{c}"), weight), color.lerp(sc, F.col(f"r_s_{c}"), weight)
        return F.when(sc < FLAT, F.col(c) + m - mc).otherwise((F.col(c) - mc) * s / sc + m)

    return _result(full, content, channels, new)


def weighted_transfer(content: DataFrame, reference: DataFrame, weights: Mapping[str, float], keys: Sequence[str] = ("image_id",), shared: Sequence[str] = ()) -> DataFrame:
    """Between content and its moment transfer, by channel weight."""
    full = _with_statistics(content, reference, list(weights), keys, shared)
    return _result(full, content, list(weights), lambda c: color.lerp(F.col(c), moved(c), weights[c]))


def reverse_blend(content: DataFrame, other: DataFrame, weights: Mapping[str, float], on: Sequence[str] = ("image_id", "x", "y")) -> DataFrame:
    """Blend with the row at the same place of the other table, restated to content's moments first."""
    channels = list(weights)
    full = aligned(content, other, channels, on)
    full = full.join(moments(content, ["image_id"], channels, "c"), "image_id").join(moments(other, ["image_id"], channels, "r"), "image_id")

    def new(c: str) -> Column:
        mc, sc, mr, sr = (F.col(f"{k}_{c}") for k in ("c_m", "c_s", "r_m", "r_s"))
        restated = F.when(sr < FLAT, F.col(f"o_{c}") - mr + mc).otherwise((F.col(f"o_{c}") - mr) * sc / sr + mc)
        return color.lerp(F.col(c), restated, weights[c])

    return _result(full, content, channels, new)


def quantile_transfer(content: DataFrame, reference: DataFrame, channels: Sequence[str], key: str = "image_id") -> DataFrame:
    """Each channel gets the reference's distribution: a value goes to the reference's value of the same cumulative share.

    Content is written once: its values are counted and then looked up, and the joins of the look-up ask of each channel
    that it is not null, which would put the formulas of computed channels into that filter, as often as they nest.
    """
    content = written(content, "content")
    own = running_totals(channel_counts(content, [key], channels), [key, "channel"], "value").select(key, "channel", "value", (F.col("upto") / F.col("total")).alias("cdf"))
    counts = in_ranges(channel_counts(reference, [], channels), ["channel", "value"], "counts")
    table = quantile_map(own, totals_in_ranges(counts, ["channel"], "value"), counts.count() // len(channels), ["channel"])
    out = content
    for c in channels:
        mine = table.filter(F.col("channel") == c).select(F.col(key).alias("key_"), F.col("value").alias("value_"), F.col("mapped").alias(f"new_{c}"))
        out = out.join(mine, (F.col(key) == F.col("key_")) & (F.col(c).cast("double") == F.col("value_"))).drop("key_", "value_")
    return _result(out, content, channels, lambda c: F.col(f"new_{c}"))


def segmented_transfer(content: DataFrame, reference: DataFrame, segment: Callable[[Column], Column], channels: Sequence[str] = LAB, strength: float = 1.0) -> DataFrame:
    """Moment transfer within segments of L, each against the reference's segment; a segment empty there stays as it is."""
    c, r = content.withColumn("segment", segment(F.col("L"))), reference.withColumn("segment", segment(F.col("L")))
    full = _with_statistics(c, r, channels, ["image_id"], ["segment"])
    return _result(full, content, channels, lambda n: color.lerp(F.col(n), moved(n), strength))


def tercile_transfer(content: DataFrame, reference: DataFrame, channels: Sequence[str] = LAB) -> DataFrame:
    """Segments by each table's own 33rd and 66th percentile of L, content's by image."""
    cut = F.when(F.col("L") <= F.col("q0"), 0).when(F.col("L") <= F.col("q1"), 1).otherwise(2)
    c = content.join(exact_quantiles(content, ["image_id"], "L", (0.33, 0.66)), "image_id").withColumn("segment", cut)
    r = reference.join(F.broadcast(exact_quantiles(reference, [], "L", (0.33, 0.66)))).withColumn("segment", cut)
    return _result(_with_statistics(c, r, channels, ["image_id"], ["segment"]), content, channels, moved)


def zone_transfer(content: DataFrame, reference: DataFrame, channels: Sequence[str] = LAB, reach: float = 15.0, strength: float = 0.8) -> DataFrame:
    """Fixed tone zones, each against the reference rows within ``reach`` of the zone's mean L, or all of them if none is.

    The reference is added up by whole units of L. A zone takes the sums of the units inside its reach, and single rows
    of the two units at its ends only.
    """
    zoned = content.withColumn("zone", color.tone_zone(F.col("L")))
    own = moments(zoned, ["image_id", "zone"], channels, "c")
    means = zoned.groupBy("image_id", "zone").agg(F.avg("L").alias("zone_L"))
    unit = F.floor("ref_L").cast("int")
    ref = reference.select(F.col("L").alias("ref_L"), *[F.col(c).cast("double").alias(f"ref_{c}_") for c in channels]).withColumn("unit", unit)
    powers = [(f"ref_{c}_", k) for c in channels for k in (1, 2)]
    sums = [F.count("*").alias("n"), *[F.sum(F.col(c) if k == 1 else F.col(c) * F.col(c)).alias(f"{c}{k}") for c, k in powers]]
    names = ["n", *[f"{c}{k}" for c, k in powers]]
    low, high = F.floor(F.col("zone_L") - reach).cast("int"), F.floor(F.col("zone_L") + reach).cast("int")
    inner = means.filter(high - low > 1).select("image_id", "zone", F.explode(F.sequence(low + 1, high - 1)).alias("unit"))
    inner = inner.join(ref.groupBy("unit").agg(*sums), "unit").select("image_id", "zone", *names)
    ends = means.select("image_id", "zone", "zone_L", F.explode(F.array_distinct(F.array(low, high))).alias("unit"))
    near = ends.join(ref, "unit").filter(F.abs(F.col("ref_L") - F.col("zone_L")) < reach)
    added = inner.unionByName(near.groupBy("image_id", "zone").agg(*sums)).groupBy("image_id", "zone").agg(*[F.sum(n).alias(n) for n in names])
    mean = {c: F.col(f"ref_{c}_1") / F.col("n") for c in channels}
    spread = {c: F.sqrt(F.greatest(F.lit(0.0), F.col(f"ref_{c}_2") / F.col("n") - mean[c] * mean[c])) for c in channels}
    stats = added.select("image_id", "zone", *[mean[c].alias(f"n_m_{c}") for c in channels], *[spread[c].alias(f"n_s_{c}") for c in channels])
    whole = moments(reference, [], channels, "w")
    full = zoned.join(own, ["image_id", "zone"]).join(stats, ["image_id", "zone"], "left").join(F.broadcast(whole))
    full = full.withColumns({f"r_{s}_{c}": F.coalesce(f"n_{s}_{c}", f"w_{s}_{c}") for c in channels for s in "ms"})
    return _result(full, content, channels, lambda c: color.lerp(F.col(c), moved(c), strength))


def adaptive_transfer(content: DataFrame, reference: DataFrame, quantile: Sequence[str] = ("L",), moment: Sequence[str] = ("a", "b")) -> DataFrame:
    """Some channels by quantile match, the others by moment transfer."""
    return quantile_transfer(moment_transfer(content, reference, moment), reference, quantile)


def guided_hybrid(content: DataFrame, reference: DataFrame, threshold: float = 12.0, on: Sequence[str] = ("image_id", "x", "y")) -> DataFrame:
    """Between adaptive and moment transfer, by how far the adaptive one moves a colour (CIEDE2000 over the threshold, at most 1)."""
    by_moments, adaptive = moment_transfer(content, reference), adaptive_transfer(content, reference)
    a = adaptive.select(*on, *[F.col(c).alias(f"a_{c}") for c in LAB])
    m = by_moments.select(*on, *[F.col(c).alias(f"m_{c}") for c in LAB])
    both = content.join(a, list(on)).join(m, list(on))
    far = with_delta_e2000(both, LAB, [f"a_{c}" for c in LAB], "w")
    return _result(far.withColumn("w", color.clamp(F.col("w") / threshold, 0.0, 1.0)), content, LAB, lambda c: color.lerp(F.col(f"a_{c}"), F.col(f"m_{c}"), F.col("w")))


def similarity_driven(content: DataFrame, reference: DataFrame, similarity: DataFrame) -> DataFrame:
    """By one row ``r`` of overall correlation: gentle weights over 0.8, only a and b under 0.3, medium weights between."""
    full = _with_statistics(content, reference, LAB, ["image_id"]).join(F.broadcast(similarity.select(F.col("r").alias("r_"))))
    weights = {"L": (0.3, 0.0, 0.6), "a": (0.5, 1.0, 0.8), "b": (0.5, 1.0, 0.8)}

    def new(c: str) -> Column:
        high, low, mid = (F.lit(w) for w in weights[c])
        return color.lerp(F.col(c), moved(c), F.when(F.col("r_") > 0.8, high).when(F.col("r_") < 0.3, low).otherwise(mid))

    return _result(full, content, LAB, new)


def area_transfer(content: DataFrame, reference: DataFrame, areas: Sequence[tuple[Sequence[float], float, Mapping[str, float]]]) -> DataFrame:
    """Inside each area (a reference colour, a tolerance, channel weights), content moves to the reference; later areas win."""
    full = _with_statistics(content, reference, LAB, ["image_id"])

    def new(c: str) -> Column:
        out = F.col(c)
        for target, tolerance, weights in areas:
            near = color.delta_e76(F.struct(*LAB), F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(LAB, target, strict=True)])) < tolerance
            out = F.when(near, color.lerp(F.col(c), moved(c), weights.get(c, 0.0))).otherwise(out)
        return out

    return _result(full, content, LAB, new)


def tiled_transfer(content: DataFrame, reference: DataFrame, tile: int = 32, overlap: int = 8, channels: Sequence[str] = LAB) -> DataFrame:
    """Moment transfer tile by tile; where tiles overlap, their results are averaged with weights that fall off at the edges."""
    step = tile - overlap
    width = min(overlap, tile // 2)

    def origins(v: str) -> Column:
        return F.transform(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(v) - tile + 1) / step)), F.floor(F.col(v) / step)), lambda k: (k * step).cast("int"))

    def weight(v: str, at: str) -> Column:
        i = F.col(v) - F.col(at)
        return F.least(F.lit(1.0), (i + 1) / F.lit(float(width + 1)), (tile - i) / F.lit(float(width + 1)))

    tiles = content.withColumn("tx", F.explode(origins("x"))).withColumn("ty", F.explode(origins("y")))
    full = _with_statistics(tiles, reference, channels, ["image_id", "tx", "ty"]).withColumn("w", weight("x", "tx") * weight("y", "ty"))
    return full.groupBy("image_id", "x", "y").agg(*[(F.sum(moved(c) * F.col("w")) / F.sum("w")).alias(c) for c in channels])


def category_transfer(content: DataFrame, references: DataFrame, channels: Sequence[str], category: str = "category", keys: Sequence[str] = ()) -> DataFrame:
    """Each category of content against the reference rows of that category."""
    return moment_transfer(content, references, channels, keys, [category])


# Registry: names and numbers that callers use, and pipelines over them.
_METHODS: dict[str, Callable[..., DataFrame]] = {}


def register_transfer(name: str, fn: Callable[..., DataFrame]) -> None:
    _METHODS[name] = fn


def get_transfer(name: str) -> Callable[..., DataFrame]:
    if name not in _METHODS:
        raise ValueError(f"unknown method {name!r}; known: {', '.join(sorted(_METHODS))}")
    return _METHODS[name]


for _name, _fn in {
    "basic": moment_transfer,
    "weighted": weighted_transfer,
    "selective": lambda content, reference, channels=("a", "b"), **_: moment_transfer(content, reference, channels),
    "adaptive": adaptive_transfer,
    "hybrid": guided_hybrid,
    "statistics_histogram": lambda content, reference, **_: adaptive_transfer(content, reference, ("a", "b"), ("L",)),
    "blend": moment_blend,
    "2": moment_transfer,
    "3": lambda content, reference, **_: quantile_transfer(content, reference, ("L",)),
    "5": moment_transfer,
}.items():
    register_transfer(_name, _fn)


def validate_steps(steps: Sequence[Mapping]) -> list[str]:
    """Everything wrong with a list of steps."""
    wrong = []
    for i, s in enumerate(steps):
        if not isinstance(s, Mapping) or "method" not in s:
            wrong.append(f"step {i}: no method")
        elif s["method"] not in _METHODS:
            wrong.append(f"step {i}: unknown method {s['method']!r}")
        elif not isinstance(s.get("params", {}), Mapping):
            wrong.append(f"step {i}: params is no mapping")
    return wrong


def transfer_pipeline(content: DataFrame, reference: DataFrame, steps: Sequence[Mapping], defaults: Mapping | None = None, intermediates: bool = False) -> DataFrame:
    """Methods one after the other, each against the original reference; with ``intermediates`` all results, by step."""
    if wrong := validate_steps(steps):
        raise ValueError("; ".join(wrong))
    out, seen = content, []
    for i, s in enumerate(steps):
        out = get_transfer(s["method"])(out, reference, **{**(defaults or {}), **s.get("params", {})})
        seen.append(out.withColumn("step", F.lit(i + 1)))
    if not intermediates:
        return out
    union = seen[0]
    for d in seen[1:]:
        union = union.unionByName(d)
    return union


def validate_config(config: Mapping) -> list[str]:
    """Everything wrong with a transfer's configuration: weights and strengths outside 0..1, unknown channels, sizes below 1."""
    wrong = [f"{k}: {v!r} is not between 0 and 1" for k, v in config.items() if k in ("weight", "strength", "blend") and not (isinstance(v, (int, float)) and 0 <= v <= 1)]
    wrong += [f"weights: {c}: {w!r} is not between 0 and 1" for c, w in config.get("weights", {}).items() if not (isinstance(w, (int, float)) and 0 <= w <= 1)]
    wrong += [f"{k}: unknown channel {c!r}" for k in ("channels", "weights") for c in config.get(k, ()) if c not in LAB]
    wrong += [f"{k}: {config[k]!r} is not a positive whole number" for k in ("tile", "segments") if k in config and not (isinstance(config[k], int) and config[k] > 0)]
    if isinstance(config.get("tile"), int) and config.get("overlap", 0) >= config["tile"]:
        wrong.append("overlap: not smaller than tile")
    return wrong + validate_steps(config.get("steps", ()))
