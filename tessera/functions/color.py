"""Colour as Column expressions: spaces, differences, masks and dithering. Nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from math import cbrt

from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB primaries under D65, and the CIE constants.
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)
DELTA = 6 / 29
LUMA = (0.2989, 0.5870, 0.1140)


def bayer(order: int = 3) -> list[int]:
    """The ordered-dither matrix of side 2**order, row by row: each quadrant repeats the smaller matrix times four."""
    matrix = [[0]]
    for _ in range(order):
        n = len(matrix)
        matrix = [[4 * matrix[y % n][x % n] + ((0, 2), (3, 1))[y // n][x // n] for x in range(2 * n)] for y in range(2 * n)]
    return [v for row in matrix for v in row]


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def _linear(channel: Column) -> Column:
    c = channel / F.lit(255.0)
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def _companded(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.lit(1.055) * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """CIELAB of an sRGB colour with channels 0..255, as struct<L,a,b>."""
    linear = [_linear(c) for c in (r, g, b)]
    f = []
    for row, white in zip(RGB_TO_XYZ, WHITE, strict=True):
        t = sum((F.lit(k) * c for k, c in zip(row, linear, strict=True)), F.lit(0.0)) / white
        f.append(F.when(t > DELTA**3, F.cbrt(t)).otherwise(t / (3 * DELTA**2) + 4 / 29))
    return F.struct((f[1] * 116 - 16).alias("L"), ((f[0] - f[1]) * 500).alias("a"), ((f[1] - f[2]) * 200).alias("b"))


def lab_of(r: int, g: int, b: int) -> tuple[float, float, float]:
    """The same of one colour, as numbers."""
    linear = [c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in (r / 255.0, g / 255.0, b / 255.0)]
    shares = [sum(k * c for k, c in zip(row, linear, strict=True)) / white for row, white in zip(RGB_TO_XYZ, WHITE, strict=True)]
    x, y, z = (cbrt(t) if t > DELTA**3 else t / (3 * DELTA**2) + 4 / 29 for t in shares)
    return y * 116 - 16, (x - y) * 500, (y - z) * 200


def hsv_of(r: int, g: int, b: int) -> tuple[float, float, float]:
    """Hue, saturation and value of one colour, each in 0..1, as numbers."""
    top, span = max(r, g, b), float(max(r, g, b) - min(r, g, b))
    if span == 0:
        sixths = 0.0
    elif top == r:
        sixths = ((g - b) / span + 6) % 6.0
    else:
        sixths = (b - r) / span + 2 if top == g else (r - g) / span + 4
    return sixths / 6, span / top if top else 0.0, top / 255.0


def boost_of(hsv: tuple[float, float, float], ranges: Sequence[dict]) -> float:
    """The product of the boosts of all focus boxes that hold one colour."""
    out = 1.0
    for f in ranges:
        target = f["target_hsv"]
        dh = abs(hsv[0] * 360 - target[0])
        if min(dh, 360 - dh) <= f["range_h"] / 2 and abs(hsv[1] * 100 - target[1]) <= f["range_s"] / 2 and abs(hsv[2] * 100 - target[2]) <= f["range_v"] / 2:
            out *= float(f["boost_factor"])
    return out


def lab_to_rgb(L: Column, a: Column, b: Column) -> Column:
    """sRGB of a CIELAB colour as struct<r,g,b> of ints: out-of-gamut values are clipped, fractions cut off."""
    fy = (L + 16) / 116
    xyz = []
    for f, white in zip((fy + a / 500, fy, fy - b / 200), WHITE, strict=True):
        xyz.append(F.when(f > DELTA, f * f * f).otherwise((f - 4 / 29) * (3 * DELTA**2)) * white)
    out = []
    for name, row in zip("rgb", XYZ_TO_RGB, strict=True):
        linear = sum((F.lit(k) * c for k, c in zip(row, xyz, strict=True)), F.lit(0.0))
        out.append(F.floor(clamp(_companded(linear), 0.0, 1.0) * 255).cast("int").alias(name))
    return F.struct(*out)


def lab_to_lab8(L: Column, a: Column, b: Column) -> Column:
    """The 8-bit encoding: L over 0..255, a and b shifted by 128."""
    eight = lambda v: clamp(F.round(v), 0.0, 255.0).cast("int")
    return F.struct(eight(L * 255 / 100).alias("L8"), eight(a + 128).alias("a8"), eight(b + 128).alias("b8"))


def lab8_to_lab(L8: Column, a8: Column, b8: Column) -> Column:
    return F.struct((L8 * 100 / 255).alias("L"), (a8 - 128).cast("double").alias("a"), (b8 - 128).cast("double").alias("b"))


def _hue(r: Column, g: Column, b: Column, top: Column, span: Column) -> Column:
    """Sixths of a turn from red."""
    side = F.when(top == r, F.pmod((g - b) / span + 6, F.lit(6.0))).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    return F.when(span == 0, F.lit(0.0)).otherwise(side)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """struct<h,s,v>, each in 0..1."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (top - low).cast("double")
    return F.struct((_hue(r, g, b, top, span) / 6).alias("h"), F.when(top == 0, 0.0).otherwise(span / top).alias("s"), (top / F.lit(255.0)).alias("v"))


def rgb_to_hsl(r: Column, g: Column, b: Column) -> Column:
    """struct<h,s,l> of ints in degrees and percent; halves go to the even neighbour."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (top - low).cast("double")
    twice = (top + low).cast("double")
    s = F.when(span == 0, 0.0).when(twice > 255, span / (510 - twice)).otherwise(span / twice)
    h = _hue(r, g, b, top, span) * 60
    return F.struct(F.bround(h).cast("int").alias("h"), F.bround(s * 100).cast("int").alias("s"), F.bround(twice / 510 * 100).cast("int").alias("l"))


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(c), 2, "0")) for c in (r, g, b)])


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def clamp_lab(L: Column, a: Column, b: Column) -> Column:
    """The colour within CIE ranges, with a flag for each channel that was not."""
    fields = [("L", L, 0.0, 100.0), ("a", a, -128.0, 127.0), ("b", b, -128.0, 127.0)]
    return F.struct(*[clamp(v, lo, hi).alias(n) for n, v, lo, hi in fields], *[((v < lo) | (v > hi)).alias(f"clipped_{n}") for n, v, lo, hi in fields])


def delta_e76(p: Column, q: Column) -> Column:
    return F.sqrt(sum((F.pow(p[c] - q[c], F.lit(2.0)) for c in ("L", "a", "b")), F.lit(0.0)))


def delta_e94(p: Column, q: Column) -> Column:
    """CIE94 for graphic arts; ``p`` is the reference."""
    c1, c2 = F.sqrt(p["a"] ** 2 + p["b"] ** 2), F.sqrt(q["a"] ** 2 + q["b"] ** 2)
    dc = c1 - c2
    dh2 = F.greatest(F.lit(0.0), (p["a"] - q["a"]) ** 2 + (p["b"] - q["b"]) ** 2 - dc**2)
    sc, sh = 1 + c1 * 0.045, 1 + c1 * 0.015
    return F.sqrt((p["L"] - q["L"]) ** 2 + (dc / sc) ** 2 + dh2 / sh**2)


def delta_e_band(d: Column) -> Column:
    return F.when(d < 1, "imperceptible").when(d < 2, "barely").when(d < 3, "noticeable").when(d < 6, "clear").otherwise("very large")


def weighted_hsv_distance(p: Column, q: Column, weights: Sequence[float] = (1.0, 1.0, 1.0)) -> Column:
    """Squared distance of two struct<h,s,v>; hue goes round."""
    dh = F.abs(p["h"] - q["h"])
    dh = F.least(dh, 1 - dh)
    return dh**2 * weights[0] + (p["s"] - q["s"]) ** 2 * weights[1] + (p["v"] - q["v"]) ** 2 * weights[2]


def weighted_rgb_distance(p: Column, q: Column, weights: Sequence[float] = (1.0, 1.0, 1.0)) -> Column:
    """Squared distance of two struct<r,g,b>; weights multiply the differences, so they count squared."""
    return sum((((p[c] - q[c]) * w) ** 2 for c, w in zip("rgb", weights, strict=True)), F.lit(0.0))


def in_focus(hsv: Column, target: Sequence[float], range_h: float, range_s: float, range_v: float) -> Column:
    """Whether a struct<h,s,v> lies within half-widths of a target in degrees and percent."""
    dh = F.abs(hsv["h"] * 360 - target[0])
    return (F.least(dh, 360 - dh) <= range_h / 2) & (F.abs(hsv["s"] * 100 - target[1]) <= range_s / 2) & (F.abs(hsv["v"] * 100 - target[2]) <= range_v / 2)


def ordered_dither(value: Column, x: Column, y: Column, amplitude: float) -> Column:
    matrix = F.array(*[F.lit(v) for v in bayer()])
    cell = F.element_at(matrix, (F.pmod(y, F.lit(8)) * 8 + F.pmod(x, F.lit(8)) + 1).cast("int"))
    return clamp(value + (cell / 64.0 - 0.5) * amplitude, 0.0, 255.0)


def preserve_extremes(mapped: Column, r: Column, g: Column, b: Column, threshold: int) -> Column:
    """``mapped`` (struct<r,g,b>), but black or white where the original's luma is within ``threshold`` of either end."""
    grey = luma(r, g, b)
    fixed = lambda v: F.struct(*[F.lit(v).cast("int").alias(c) for c in "rgb"])
    return F.when(grey <= threshold, fixed(0)).when(grey >= 255 - threshold, fixed(255)).otherwise(mapped)


def luminance_segment(L: Column, segments: int) -> Column:
    return clamp(F.floor(L * segments / 100), 0, segments - 1).cast("int")


def tone_zone(L: Column) -> Column:
    return F.when(L < 33, "shadows").when(L < 67, "midtones").otherwise("highlights")


def lerp(a: Column, b: Column, weight: Column | float) -> Column:
    weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    return a * (1 - weight) + b * weight


def ramp(i: Column, n: int) -> Column:
    """The i-th of n evenly spaced values from 0 to 1."""
    return i / F.lit(float(max(1, n - 1)))


