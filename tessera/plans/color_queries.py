"""Queries of colour expressions and palettes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import color
from tessera.operators import palette as pal
from tessera.operators import parameters, quality
from tessera.operators.difference import with_delta_e2000
from tessera.sources.images import decimated
from tessera.plans.pixel_tables import LAB_SQL, PAIRS_SQL, PIXELS_SQL, lab_sql, labs, pairs, pixels, rounded, rounded_sql

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _rgb():
    return F.col("r"), F.col("g"), F.col("b")


@query(f"WITH {LAB_SQL} SELECT image_id, x, y, {rounded_sql('L', 'a', 'b')} FROM labs")
def rgb_to_lab(spark: SparkSession, d: str) -> DataFrame:
    return rounded(labs(spark, d), "L", "a", "b")


_F = {"fy": "((L + 16) / 116)"}
_X, _Y, _Z = (f"(CASE WHEN {f} > {6 / 29!r}::DOUBLE THEN {f} * {f} * {f} ELSE ({f} - {4 / 29!r}::DOUBLE) * {3 * (6 / 29) ** 2!r}::DOUBLE END * {w}::DOUBLE)" for f, w in zip((f"({_F['fy']} + a / 500)", _F["fy"], f"({_F['fy']} - b / 200)"), color.WHITE, strict=True))


def channel_sql(row):
    lin = "(" + " + ".join(f"{k}::DOUBLE * {v}" for k, v in zip(row, (_X, _Y, _Z), strict=True)) + ")"
    comp = f"(CASE WHEN {lin} <= 0.0031308 THEN {lin} * 12.92 ELSE 1.055::DOUBLE * pow(greatest({lin}, 0.0), {1 / 2.4!r}::DOUBLE) - 0.055 END)"
    return f"CAST(floor(least(greatest({comp}, 0.0), 1.0) * 255) AS INT)"


@query(f"WITH {LAB_SQL} SELECT image_id, x, y, " + ", ".join(f"{channel_sql(row)} AS {c}" for c, row in zip("rgb", color.XYZ_TO_RGB, strict=True)) + " FROM (SELECT image_id, x, y, L * 0.93::DOUBLE + 2 AS L, a * 0.9::DOUBLE AS a, b * 0.9::DOUBLE AS b FROM labs)")
def lab_to_rgb(spark: SparkSession, d: str) -> DataFrame:
    """Colours that did not come from whole channels, so that no result stands on the border between two."""
    paler = labs(spark, d).select("image_id", "x", "y", (F.col("L") * 0.93 + 2).alias("L"), (F.col("a") * 0.9).alias("a"), (F.col("b") * 0.9).alias("b"))
    return paler.select("image_id", "x", "y", color.lab_to_rgb(F.col("L"), F.col("a"), F.col("b")).alias("rgb")).select("image_id", "x", "y", "rgb.*")


_LAB8 = "CAST(least(255, greatest(0, round(L * 255 / 100))) AS INT) AS L8, CAST(least(255, greatest(0, round(a + 128))) AS INT) AS a8, CAST(least(255, greatest(0, round(b + 128))) AS INT) AS b8"


@query(f"WITH {LAB_SQL}, e AS (SELECT image_id, x, y, {_LAB8} FROM labs) SELECT image_id, x, y, L8, a8, b8, round(L8 * 100 / 255.0, 6) AS L, CAST(a8 - 128 AS DOUBLE) AS a, CAST(b8 - 128 AS DOUBLE) AS b FROM e")
def lab8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    e = labs(spark, d).select("image_id", "x", "y", color.lab_to_lab8(F.col("L"), F.col("a"), F.col("b")).alias("e")).select("image_id", "x", "y", "e.*")
    back = e.select("*", color.lab8_to_lab(F.col("L8"), F.col("a8"), F.col("b8")).alias("l"))
    return rounded(back.select("image_id", "x", "y", "L8", "a8", "b8", "l.*"), "L")


_HUE = """CASE WHEN mx = mn THEN 0.0 WHEN mx = r THEN ((g - b) / (mx - mn)::DOUBLE + 6) % 6 WHEN mx = g THEN (b - r) / (mx - mn)::DOUBLE + 2 ELSE (r - g) / (mx - mn)::DOUBLE + 4 END"""
_SPAN = PIXELS_SQL + ", s AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM pixels)"


@query(f"WITH {_SPAN} SELECT image_id, x, y, round(({_HUE}) / 6, 6) AS h, round(CASE WHEN mx = 0 THEN 0 ELSE (mx - mn) / mx::DOUBLE END, 6) AS s, round(mx / 255.0, 6) AS v FROM s")
def rgb_to_hsv(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pixels(spark, d).select("image_id", "x", "y", color.rgb_to_hsv(*_rgb()).alias("c")).select("image_id", "x", "y", "c.*"), "h", "s", "v")


@query(
    f"""WITH {_SPAN} SELECT image_id, x, y, CAST(round_even(({_HUE}) * 60, 0) AS INT) AS h,
 CAST(round_even(CASE WHEN mx = mn THEN 0 WHEN mx + mn > 255 THEN (mx - mn)::DOUBLE / (510 - mx - mn) ELSE (mx - mn)::DOUBLE / (mx + mn) END * 100, 0) AS INT) AS s,
 CAST(round_even((mx + mn)::DOUBLE / 510 * 100, 0) AS INT) AS l FROM s"""
)
def rgb_to_hsl(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("image_id", "x", "y", color.rgb_to_hsl(*_rgb()).alias("c")).select("image_id", "x", "y", "c.*")


@query(f"WITH {PIXELS_SQL} SELECT image_id, x, y, printf('#%02x%02x%02x', r, g, b) AS hex FROM pixels")
def rgb_hex(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("image_id", "x", "y", color.rgb_hex(*_rgb()).alias("hex"))


@query(f"WITH {PIXELS_SQL} SELECT image_id, x, y, round(r * 0.2989 + g * 0.5870 + b * 0.1140, 4)::DOUBLE AS luma FROM pixels")
def luma(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("image_id", "x", "y", F.round(color.luma(*_rgb()), 4).alias("luma"))


@query(
    f"""WITH {LAB_SQL}, w AS (SELECT image_id, x, y, L * 1.2 - 10 AS L, a * 1.5 AS a, b * 1.5 AS b FROM labs)
SELECT image_id, x, y, round(least(100, greatest(0, L)), 6) + 0.0 AS L, round(least(127, greatest(-128, a)), 6) + 0.0 AS a, round(least(127, greatest(-128, b)), 6) + 0.0 AS b,
 L < 0 OR L > 100 AS clipped_L, a < -128 OR a > 127 AS clipped_a, b < -128 OR b > 127 AS clipped_b FROM w"""
)
def lab_clamp(spark: SparkSession, d: str) -> DataFrame:
    wide = labs(spark, d).select("image_id", "x", "y", color.clamp_lab(F.col("L") * 1.2 - 10, F.col("a") * 1.5, F.col("b") * 1.5).alias("c"))
    return rounded(wide.select("image_id", "x", "y", "c.*"), "L", "a", "b")


def _pair_frame(spark, d):
    p, q = pairs(spark, d)
    p = p.select("image_id", "x", "y", F.struct("L", "a", "b").alias("p"))
    return p.join(q.select("image_id", "x", "y", F.struct("L", "a", "b").alias("q")), ["image_id", "x", "y"])


_PQ = PAIRS_SQL + ", pq AS (SELECT l.image_id, l.x, l.y, l.L AS L1, l.a AS a1, l.b AS b1, r.L AS L2, r.a AS a2, r.b AS b2 FROM left_ l JOIN right_ r USING (image_id, x, y))"
_E76 = "sqrt(pow(L1 - L2, 2) + pow(a1 - a2, 2) + pow(b1 - b2, 2))"


@query(f"WITH {_PQ} SELECT image_id, x, y, round({_E76}, 6) AS delta_e FROM pq")
def delta_e76(spark: SparkSession, d: str) -> DataFrame:
    return _pair_frame(spark, d).select("image_id", "x", "y", F.round(color.delta_e76(F.col("p"), F.col("q")), 6).alias("delta_e"))


@query(
    f"""WITH {_PQ}, c AS (SELECT *, sqrt(a1*a1 + b1*b1) AS c1, sqrt(a2*a2 + b2*b2) AS c2 FROM pq)
SELECT image_id, x, y, round(sqrt(pow(L1-L2,2) + pow((c1-c2)/(1+0.045*c1),2) + greatest(0, pow(a1-a2,2)+pow(b1-b2,2)-pow(c1-c2,2))/pow(1+0.015*c1,2)), 5) AS delta_e FROM c"""
)
def delta_e94(spark: SparkSession, d: str) -> DataFrame:
    return _pair_frame(spark, d).select("image_id", "x", "y", F.round(color.delta_e94(F.col("p"), F.col("q")), 5).alias("delta_e"))


E2000_SQL = """e0 AS (SELECT *, pow((sqrt(a1*a1+b1*b1) + sqrt(a2*a2+b2*b2)) / 2, 7::DOUBLE) AS c7m FROM pq),
e1 AS (SELECT *, 0.5 * (1 - sqrt(c7m / (c7m + pow(25.0::DOUBLE, 7)))) AS gg FROM e0),
e2 AS (SELECT *, a1 * (1 + gg) AS p1, a2 * (1 + gg) AS p2 FROM e1),
e3 AS (SELECT *, sqrt(p1*p1+b1*b1) AS c1, sqrt(p2*p2+b2*b2) AS c2, CASE WHEN p1 = 0 AND b1 = 0 THEN 0 ELSE (degrees(atan2(b1, p1)) + 360) % 360 END AS h1,
 CASE WHEN p2 = 0 AND b2 = 0 THEN 0 ELSE (degrees(atan2(b2, p2)) + 360) % 360 END AS h2 FROM e2),
e4 AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh,
 CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm,
 (L1 + L2) / 2 AS lm, (c1 + c2) / 2 AS cm FROM e3),
e5 AS (SELECT *, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) AS dhh,
 1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.20 * cos(radians(4 * hm - 63)) AS t,
 pow(cm, 7::DOUBLE) AS c7 FROM e4),
e6 AS (SELECT *, (L2 - L1) / (1 + 0.015 * pow(lm - 50, 2) / sqrt(20 + pow(lm - 50, 2))) AS fl, (c2 - c1) / (1 + 0.045 * cm) AS fc, dhh / (1 + 0.015 * cm * t) AS fh,
 -2 * sqrt(c7 / (c7 + pow(25.0::DOUBLE, 7))) * sin(radians(60 * exp(-pow((hm - 275) / 25, 2)))) AS rt FROM e5),
e7 AS (SELECT *, sqrt(fl*fl + fc*fc + fh*fh + rt*fc*fh) AS de FROM e6)"""


@query(f"WITH {_PQ}, {E2000_SQL} SELECT image_id, x, y, round(de, 5) AS delta_e FROM e7")
def delta_e2000(spark: SparkSession, d: str) -> DataFrame:
    p, q = pairs(spark, d)
    both = p.join(q.select("image_id", "x", "y", *[F.col(c).alias(f"o_{c}") for c in "Lab"]), ["image_id", "x", "y"])
    return with_delta_e2000(both, "Lab", [f"o_{c}" for c in "Lab"]).select("image_id", "x", "y", F.round("delta_e", 5).alias("delta_e"))


@query(f"WITH {_PQ} SELECT image_id, CASE WHEN d < 1 THEN 'imperceptible' WHEN d < 2 THEN 'barely' WHEN d < 3 THEN 'noticeable' WHEN d < 6 THEN 'clear' ELSE 'very large' END AS band, count(*) AS n FROM (SELECT image_id, {_E76} / 10 AS d FROM pq) GROUP BY ALL")
def delta_e_band(spark: SparkSession, d: str) -> DataFrame:
    return _pair_frame(spark, d).select("image_id", color.delta_e_band(color.delta_e76(F.col("p"), F.col("q")) / 10).alias("band")).groupBy("image_id", "band").agg(F.count("*").alias("n"))


_BAYER = "[" + ", ".join(map(str, color.bayer())) + "]"


@query(f"WITH {PIXELS_SQL} SELECT image_id, x, y, " + ", ".join(f"round(least(255, greatest(0, {c} + ({_BAYER}[(y % 8) * 8 + x % 8 + 1] / 64.0 - 0.5) * 32)), 6)::DOUBLE AS {c}" for c in "rgb") + " FROM pixels")
def bayer_dither(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pixels(spark, d).select("image_id", "x", "y", *[color.ordered_dither(c, F.col("x"), F.col("y"), 32.0).alias(n) for n, c in zip("rgb", _rgb(), strict=True)]), "r", "g", "b")


_GREY = "(r * 0.2989::DOUBLE + g * 0.5870::DOUBLE + b * 0.1140::DOUBLE)"


@query(f"WITH {PIXELS_SQL} SELECT image_id, x, y, " + ", ".join(f"CASE WHEN {_GREY} <= 40 THEN 0 WHEN {_GREY} >= 215 THEN 255 ELSE 255 - {c} END AS {c}" for c in "rgb") + " FROM pixels")
def preserve_extremes(spark: SparkSession, d: str) -> DataFrame:
    mapped = F.struct(*[(255 - c).alias(n) for n, c in zip("rgb", _rgb(), strict=True)])
    return pixels(spark, d).select("image_id", "x", "y", color.preserve_extremes(mapped, *_rgb(), 40).alias("c")).select("image_id", "x", "y", "c.*")


@query(f"WITH {LAB_SQL} SELECT image_id, x, y FROM labs WHERE sqrt(pow(L - 50, 2) + pow(a - 20, 2) + pow(b + 10, 2)) < 40")
def color_mask(spark: SparkSession, d: str) -> DataFrame:
    target = F.struct(F.lit(50.0).alias("L"), F.lit(20.0).alias("a"), F.lit(-10.0).alias("b"))
    return labs(spark, d).filter(color.delta_e76(F.struct("L", "a", "b"), target) < 40).select("image_id", "x", "y")


@query(f"WITH {LAB_SQL} SELECT image_id, CASE WHEN L < 33 THEN 'shadows' WHEN L < 67 THEN 'midtones' ELSE 'highlights' END AS zone, count(*) AS n FROM labs GROUP BY ALL")
def tone_zones(spark: SparkSession, d: str) -> DataFrame:
    return labs(spark, d).groupBy("image_id", color.tone_zone(F.col("L")).alias("zone")).agg(F.count("*").alias("n"))


@query(f"WITH {PIXELS_SQL}, ends AS (SELECT image_id, max(x) AS mx, max(y) AS my FROM pixels GROUP BY image_id) SELECT p.image_id, x, y FROM pixels p JOIN ends USING (image_id) WHERE x = 0 OR y = 0 OR x = mx OR y = my")
def border_pixels(spark: SparkSession, d: str) -> DataFrame:
    p = pixels(spark, d)
    ends = p.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    return p.join(ends, "image_id").filter("x = 0 OR y = 0 OR x = mx OR y = my").select("image_id", "x", "y")


# One entry for each brand, from all parts of it: a palette of as many entries as there are brands.
PALETTE_SQL = """palette AS (SELECT CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INT) AS idx, CAST((sum(p_partkey) * 37) % 256 AS INT) AS r, CAST((sum(p_partkey) * 101) % 256 AS INT) AS g, CAST((sum(p_partkey) * 197) % 256 AS INT) AS b FROM part GROUP BY p_brand)"""


def palette_table(spark: SparkSession, d: str) -> DataFrame:
    by_brand = spark.read.parquet(f"{d}/part.parquet").groupBy("p_brand").agg(F.sum("p_partkey").alias("k"))
    return by_brand.select((F.row_number().over(Window.orderBy("p_brand")) - 1).alias("idx"), *[((F.col("k") * m) % 256).cast("int").alias(c) for c, m in zip("rgb", (37, 101, 197), strict=True)])


def _palette(spark, d):
    return [(e.r, e.g, e.b) for e in palette_table(spark, d).orderBy("idx").collect()]


def _map_sql(distance: str) -> str:
    return f"""WITH {PIXELS_SQL}, {PALETTE_SQL}, colours AS (SELECT DISTINCT r, g, b FROM pixels),
d AS (SELECT c.r, c.g, c.b, q.idx, q.r AS pr, q.g AS pg, q.b AS pb, {distance} AS dist FROM colours c, palette q),
best AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY r, g, b ORDER BY dist, idx) = 1)
SELECT image_id, x, y, idx, pr, pg, pb FROM pixels JOIN best USING (r, g, b)"""


def _mapped(spark, d, **options):
    return pal.nearest(pixels(spark, d), _palette(spark, d), **options).select("image_id", "x", "y", "idx", "pr", "pg", "pb")


@query(_map_sql("pow(c.r - q.r, 2) + pow(c.g - q.g, 2) + pow(c.b - q.b, 2)"))
def map_rgb(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, metric="rgb")


@query(_map_sql("pow((c.r - q.r) * 0.5, 2) + pow((c.g - q.g) * 1.0, 2) + pow((c.b - q.b) * 0.25, 2)"))
def map_weighted_rgb(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, metric="rgb", weights=(0.5, 1.0, 0.25))


_LP, _LQ = lab_sql("c.r", "c.g", "c.b"), lab_sql("q.r", "q.g", "q.b")


@query(_map_sql("sqrt(" + " + ".join(f"pow({p} - {q}, 2)" for p, q in zip(_LP, _LQ, strict=True)) + ")"))
def map_lab(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, metric="lab")


def _hsv_sql(t: str) -> tuple[str, str, str]:
    r, g, b = f"{t}.r", f"{t}.g", f"{t}.b"
    mx, span = f"greatest({r}, {g}, {b})", f"(greatest({r}, {g}, {b}) - least({r}, {g}, {b}))::DOUBLE"
    hue = f"(CASE WHEN {span} = 0 THEN 0.0 WHEN {mx} = {r} THEN (({g} - {b}) / {span} + 6) % 6 WHEN {mx} = {g} THEN ({b} - {r}) / {span} + 2 ELSE ({r} - {g}) / {span} + 4 END / 6)"
    return hue, f"(CASE WHEN {mx} = 0 THEN 0 ELSE {span} / {mx} END)", f"({mx} / 255.0::DOUBLE)"


_HP, _HQ = _hsv_sql("c"), _hsv_sql("q")
_HSV_D = f"(pow(least(abs({_HP[0]} - {_HQ[0]}), 1 - abs({_HP[0]} - {_HQ[0]})), 2) * 3.0 + pow({_HP[1]} - {_HQ[1]}, 2) + pow({_HP[2]} - {_HQ[2]}, 2))"
FOCUS = [{"target_hsv": [200.0, 60.0, 70.0], "range_h": 120.0, "range_s": 90.0, "range_v": 80.0, "boost_factor": 3.0}, {"target_hsv": [350.0, 50.0, 50.0], "range_h": 80.0, "range_s": 100.0, "range_v": 100.0, "boost_factor": 2.0}]


def _box_sql(f: dict) -> str:
    h, s, v = _HQ
    t = f["target_hsv"]
    return f"(CASE WHEN least(abs({h} * 360 - {t[0]}), 360 - abs({h} * 360 - {t[0]})) <= {f['range_h'] / 2} AND abs({s} * 100 - {t[1]}) <= {f['range_s'] / 2} AND abs({v} * 100 - {t[2]}) <= {f['range_v'] / 2} THEN {f['boost_factor']} ELSE 1.0 END)"


@query(_map_sql(_HSV_D))
def map_hsv(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, metric="hsv", weights=(3.0, 1.0, 1.0))


@query(_map_sql(_HSV_D + " / (" + " * ".join(map(_box_sql, FOCUS)) + ")"))
def map_focus(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, metric="hsv", weights=(3.0, 1.0, 1.0), focus=FOCUS)


@query(f"WITH {PALETTE_SQL} SELECT idx, r, g, b, CAST(row_number() OVER (ORDER BY r * 0.2989::DOUBLE + g * 0.5870::DOUBLE + b * 0.1140::DOUBLE, idx) AS INT) AS place FROM palette")
def palette_by_brightness(spark: SparkSession, d: str) -> DataFrame:
    return pal.sort_palette(palette_table(spark, d))


@query(f"WITH {PALETTE_SQL} SELECT 'success,' || count(*) || ',' || string_agg(r || ',' || g || ',' || b, ',' ORDER BY idx) AS wire FROM palette")
def palette_wire(spark: SparkSession, d: str) -> DataFrame:
    return pal.encode_palette(palette_table(spark, d))


@query(f"WITH {PALETTE_SQL} SELECT idx, r, g, b FROM palette")
def palette_wire_decoded(spark: SparkSession, d: str) -> DataFrame:
    return pal.encode_palette(palette_table(spark, d)).select(F.inline(pal.decode_palette(F.col("wire"))["entries"]))


@query(f"WITH {PALETTE_SQL}, gone AS (SELECT DISTINCT CAST((p_size * 37) % 256 AS INT) AS r FROM part) SELECT idx, r, g, b FROM palette WHERE r NOT IN (SELECT r FROM gone)")
def palette_without(spark: SparkSession, d: str) -> DataFrame:
    gone = spark.read.parquet(f"{d}/part.parquet").select(((F.col("p_size") * 37) % 256).cast("int").alias("r")).distinct()
    return palette_table(spark, d).join(gone, "r", "left_anti").select("idx", "r", "g", "b")


@query(f"WITH {PIXELS_SQL} SELECT image_id, count(DISTINCT (r, g, b)) AS n_colours FROM pixels GROUP BY image_id")
def distinct_colors(spark: SparkSession, d: str) -> DataFrame:
    return pal.distinct_colours(pixels(spark, d)).select("image_id", "n_colours")


@query()
def kmeans_palette(spark: SparkSession, d: str) -> DataFrame:
    entries = pal.kmeans_palette(pixels(spark, d), 8)
    return spark.createDataFrame([(i, *e) for i, e in enumerate(entries)], "idx int, r int, g int, b int")


@query()
def median_cut_palette(spark: SparkSession, d: str) -> DataFrame:
    return pal.median_cut_palette(pixels(spark, d), 8)


@query()
def palette_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Extract a palette, dither, map to the nearest entry, keep black and white, blend edges, filter by the median."""
    p = pixels(spark, d)
    entries = pal.with_extremes([(e.r, e.g, e.b) for e in pal.median_cut_palette(p, 8).collect()])
    settings = {n: default for n, (default, *_) in parameters.LIMITS.items()}
    return pal.map_image(p, entries, settings | {"dither": True, "preserve_extremes": True, "edge_blur": True, "median": True})


@query(_map_sql("pow((c.r - q.r) * 0.5, 2) + pow((c.g - q.g) * 1.0, 2) + pow((c.b - q.b) * 0.25, 2)"))
def map_palette_table(spark: SparkSession, d: str) -> DataFrame:
    """The palette as a table of at most 256 rows."""
    return pal.nearest_in_table(pixels(spark, d), palette_table(spark, d), (0.5, 1.0, 0.25)).select("image_id", "x", "y", "idx", "pr", "pg", "pb")


@query(f"WITH {PIXELS_SQL}, s AS (SELECT image_id, CAST(ceil((greatest(max(x), max(y)) + 1) / 40.0) AS BIGINT) AS step FROM pixels GROUP BY image_id) SELECT image_id, x, y, r, g, b FROM pixels JOIN s USING (image_id) WHERE x % step = 0 AND y % step = 0")
def decimated_pixels(spark: SparkSession, d: str) -> DataFrame:
    return decimated(pixels(spark, d), 40)


@query(f"WITH {PIXELS_SQL}, v AS (SELECT image_id, unnest([r, g, b])::DOUBLE AS v FROM pixels) SELECT image_id, round(var_pop(v), 4) AS variance FROM v GROUP BY image_id")
def colour_variance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.colour_variance(pixels(spark, d)), "variance", digits=4)


@query(f"WITH {PIXELS_SQL} SELECT image_id, x, y, round(x / 63.0, 6) AS ramp FROM pixels")
def ramp(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("image_id", "x", "y", F.round(color.ramp(F.col("x"), 64), 6).alias("ramp"))
