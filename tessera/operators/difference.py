"""Colour differences whose terms build on each other, as columns in steps: no term is worked out twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cos(angle: Column) -> Column:
    return F.cos(F.radians(angle))


def with_delta_e2000(df: DataFrame, p: Sequence[str], q: Sequence[str], name: str = "delta_e") -> DataFrame:
    """``df`` with CIEDE2000 (unit weights) between the colours in the columns ``p`` and ``q``, each L, a and b."""
    (l1, a1, b1), (l2, a2, b2) = ([F.col(c) for c in side] for side in (p, q))
    v = lambda n: F.col(f"_e_{n}")
    angle = lambda a, b: F.when((a == 0) & (b == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, a)) + 360, F.lit(360.0)))
    seventh = lambda c: F.sqrt(c / (c + 25.0**7))
    turn, both = v("h2") - v("h1"), v("h1") + v("h2")
    steps = [
        {"c7": F.pow((F.sqrt(a1 * a1 + b1 * b1) + F.sqrt(a2 * a2 + b2 * b2)) / 2, F.lit(7.0))},
        {"g": (1 - seventh(v("c7"))) / 2 + 1},
        {"a1": a1 * v("g"), "a2": a2 * v("g")},
        {"c1": F.sqrt(v("a1") * v("a1") + b1 * b1), "c2": F.sqrt(v("a2") * v("a2") + b2 * b2), "h1": angle(v("a1"), b1), "h2": angle(v("a2"), b2)},
        {"turn": turn, "both": both, "cc": v("c1") * v("c2"), "cm": (v("c1") + v("c2")) / 2, "off": ((l1 + l2) / 2 - 50) * ((l1 + l2) / 2 - 50)},
        {
            "dh": F.when(v("cc") == 0, 0.0).when(F.abs(v("turn")) <= 180, v("turn")).when(v("turn") > 180, v("turn") - 360).otherwise(v("turn") + 360),
            "hm": F.when(v("cc") == 0, v("both")).when(F.abs(v("turn")) <= 180, v("both") / 2).when(v("both") < 360, (v("both") + 360) / 2).otherwise((v("both") - 360) / 2),
            "c7": F.pow(v("cm"), F.lit(7.0)),
        },
        {
            "t": 1 - _cos(v("hm") - 30) * 0.17 + _cos(v("hm") * 2) * 0.24 + _cos(v("hm") * 3 + 6) * 0.32 - _cos(v("hm") * 4 - 63) * 0.20,
            "r": seventh(v("c7")) * -2 * F.sin(F.radians(F.exp(-(((v("hm") - 275) / 25) * ((v("hm") - 275) / 25))) * 60)),
        },
        {
            "l": (l2 - l1) / (1 + v("off") * 0.015 / F.sqrt(v("off") + 20)),
            "c": (v("c2") - v("c1")) / (1 + v("cm") * 0.045),
            "h": F.sqrt(v("cc")) * F.sin(F.radians(v("dh") / 2)) * 2 / (1 + v("cm") * v("t") * 0.015),
        },
        {"out": F.sqrt(v("l") * v("l") + v("c") * v("c") + v("h") * v("h") + v("r") * v("c") * v("h"))},
    ]
    out = df
    for step in steps:
        out = out.withColumns({f"_e_{n}": e for n, e in step.items()})
    return out.select(*[F.col(c) for c in df.columns], v("out").alias(name))
