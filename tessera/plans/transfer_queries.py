"""Queries of distributions, transfers, quality reports and stencils over pixel tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import color
from tessera.operators import distribution as dist
from tessera.operators import quality, stencil
from tessera.operators import transfer as tr
from tessera.plans.color_queries import E2000_SQL, channel_sql
from tessera.plans.pixel_tables import CHANNELS, LAB_SQL, MASK_SQL, PAIRS_SQL, PIXELS_SQL, content_and_reference, labs, mask, pairs, pixels, rounded, rounded_sql

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _out(df: DataFrame) -> DataFrame:
    return rounded(df.select("image_id", "x", "y", *CHANNELS), *CHANNELS, digits=4)


_OUT = "image_id, x, y, " + rounded_sql(*CHANNELS, digits=4)


def _stats(table: str, prefix: str, by: str = "", where: str = "") -> str:
    cols = ", ".join(f"avg({c}) AS {prefix}_m_{c}, stddev_pop({c}) AS {prefix}_s_{c}" for c in CHANNELS)
    return f"(SELECT {by + ', ' if by else ''}{cols} FROM {table} {where} {'GROUP BY ' + by if by else ''})"


def _moved(c: str, p: str = "") -> str:
    return f"(CASE WHEN r_m_{c} IS NULL OR c_m_{c} IS NULL THEN {p}{c} WHEN c_s_{c} < 1e-6 THEN {p}{c} + r_m_{c} - c_m_{c} ELSE ({p}{c} - c_m_{c}) * r_s_{c} / c_s_{c} + r_m_{c} END)"


_JOINED = f"content JOIN {_stats('content', 'c', 'image_id')} USING (image_id) CROSS JOIN {_stats('reference', 'r')}"


def _transfer_sql(**new: str) -> str:
    cols = ", ".join(f"round({new.get(c, c)}, 4) + 0.0 AS {c}" for c in CHANNELS)
    return f"WITH {LAB_SQL} SELECT image_id, x, y, {cols} FROM {_JOINED}"


# Distributions


@query(f"WITH {LAB_SQL} SELECT image_id, " + ", ".join(f"round(avg({c}), 4) + 0.0 AS {c}_mean, round(stddev_pop({c}), 4) AS {c}_std, round(min({c}), 4) + 0.0 AS {c}_min, round(max({c}), 4) + 0.0 AS {c}_max" for c in CHANNELS) + ", count(*) AS n FROM labs GROUP BY image_id")
def channel_stats(spark: SparkSession, d: str) -> DataFrame:
    out = dist.channel_moments(labs(spark, d), ["image_id"], CHANNELS)
    return rounded(out, *[c for c in out.columns if c not in ("image_id", "n")], digits=4)


@query(f"WITH {PIXELS_SQL} SELECT image_id, count(*) AS n, round(avg(r), 4) AS r_mean, round(stddev_pop(r), 4) AS r_std, round(avg(g), 4) AS g_mean, round(stddev_pop(g), 4) AS g_std FROM pixels GROUP BY image_id")
def merged_moments(spark: SparkSession, d: str) -> DataFrame:
    """Moments of images put together from moments of their rows of pixels."""
    parts = dist.partial_moments(pixels(spark, d), ["image_id", "y"], ["r", "g"])
    return rounded(dist.merge_moments(parts, ["image_id"], ["r", "g"]), "r_mean", "r_std", "g_mean", "g_std", digits=4)


_HIST = """, h AS (SELECT i.image_id, b.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT image_id FROM pixels) i CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range(256)) b
 LEFT JOIN (SELECT image_id, g AS bin, count(*) AS n FROM pixels GROUP BY ALL) c USING (image_id, bin))"""


@query(f"WITH {PIXELS_SQL}{_HIST} SELECT * FROM h")
def histogram256(spark: SparkSession, d: str) -> DataFrame:
    return dist.histogram(pixels(spark, d), "image_id", "g")


_CDF = _HIST + ", cdf AS (SELECT image_id, bin, n, sum(n) OVER (PARTITION BY image_id ORDER BY bin)::DOUBLE / sum(n) OVER (PARTITION BY image_id) AS cdf FROM h)"


@query(f"WITH {PIXELS_SQL}{_CDF} SELECT image_id, bin, n, round(cdf, 6) AS cdf FROM cdf")
def cdf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dist.cumulative(dist.histogram(pixels(spark, d), "image_id", "g"), "image_id", "bin"), "cdf")


_LUT = _CDF + """, lut AS (SELECT c.image_id, c.bin, r.bin AS mapped FROM (SELECT * FROM cdf WHERE image_id <> 'img3') c CROSS JOIN (SELECT bin, cdf FROM cdf WHERE image_id = 'img3') r
 QUALIFY row_number() OVER (PARTITION BY c.image_id, c.bin ORDER BY abs(r.cdf - c.cdf), r.bin) = 1)"""


def _lut(spark, d):
    shares = dist.cumulative(dist.histogram(pixels(spark, d), "image_id", "g"), "image_id", "bin")
    return dist.nearest_cdf_table(shares.filter("image_id <> 'img3'"), shares.filter("image_id = 'img3'").select("bin", "cdf"))


@query(f"WITH {PIXELS_SQL}{_LUT} SELECT image_id, bin, mapped FROM lut")
def lut_nearest_cdf(spark: SparkSession, d: str) -> DataFrame:
    return _lut(spark, d)


@query(f"WITH {PIXELS_SQL}{_LUT} SELECT image_id, x, y, r, mapped AS g, b FROM pixels p JOIN lut l USING (image_id) WHERE l.bin = p.g")
def histogram_match_l8(spark: SparkSession, d: str) -> DataFrame:
    """Match of one 8-bit channel through its table of nearest shares."""
    table = _lut(spark, d).withColumnRenamed("bin", "g")
    return pixels(spark, d).filter("image_id <> 'img3'").join(table, ["image_id", "g"]).select("image_id", "x", "y", "r", F.col("mapped").alias("g"), "b")


def _quantile_cte(c: str, content: str = "content") -> str:
    """q_<c>(image_id, value, mapped): numpy-like interpolation between the reference's neighbouring shares."""
    return f""", n_{c} AS (SELECT image_id, {c} AS value, count(*) AS n FROM {content} GROUP BY ALL),
cc_{c} AS (SELECT image_id, value, sum(n) OVER (PARTITION BY image_id ORDER BY value)::DOUBLE / sum(n) OVER (PARTITION BY image_id) AS cdf FROM n_{c}),
rr_{c} AS (SELECT value, sum(n) OVER (ORDER BY value)::DOUBLE / sum(n) OVER () AS cdf FROM (SELECT {c} AS value, count(*) AS n FROM reference GROUP BY ALL)),
lo_{c} AS (SELECT c.image_id, c.value, c.cdf, r.value AS lv, r.cdf AS lc FROM cc_{c} c ASOF LEFT JOIN rr_{c} r ON c.cdf >= r.cdf),
hi_{c} AS (SELECT c.*, r.value AS hv, r.cdf AS hc FROM lo_{c} c ASOF LEFT JOIN rr_{c} r ON c.cdf <= r.cdf),
q_{c} AS (SELECT image_id, value, CASE WHEN lv IS NULL THEN hv WHEN hv IS NULL OR lc = cdf THEN lv ELSE lv + (hv - lv) * (cdf - lc) / (hc - lc) END AS mapped FROM hi_{c})"""


@query(f"WITH {LAB_SQL}{_quantile_cte('L')} SELECT image_id, x, y, round(mapped, 4) + 0.0 AS L, round(a, 4) + 0.0 AS a, round(b, 4) + 0.0 AS b FROM content c JOIN q_L q USING (image_id) WHERE q.value = c.L")
def quantile_match(spark: SparkSession, d: str) -> DataFrame:
    return _out(tr.quantile_transfer(*content_and_reference(spark, d), ["L"]))


_SEG = "CAST(least(4, greatest(0, floor(L * 5 / 100))) AS INT)"


@query(f"WITH {LAB_SQL} SELECT image_id, {_SEG} AS segment, count(*) AS n, " + ", ".join(f"round(avg({c}), 4) + 0.0 AS {c}_mean, round(stddev_pop({c}), 4) AS {c}_std" for c in CHANNELS) + " FROM labs GROUP BY ALL")
def segment_stats(spark: SparkSession, d: str) -> DataFrame:
    out = dist.channel_moments(labs(spark, d).withColumn("segment", color.luminance_segment(F.col("L"), 5)), ["image_id", "segment"], CHANNELS)
    wanted = [f"{c}_{s}" for c in CHANNELS for s in ("mean", "std")]
    return rounded(out.select("image_id", "segment", "n", *wanted), *wanted, digits=4)


@query(f"WITH {LAB_SQL}, s AS (SELECT image_id, {_SEG} AS segment, count(*) AS n FROM labs GROUP BY ALL) SELECT image_id, segment, n, CAST(coalesce(sum(n) OVER (PARTITION BY image_id ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM s".replace(" AS offset", ' AS "offset"'))
def prefix_offsets(spark: SparkSession, d: str) -> DataFrame:
    counts = labs(spark, d).groupBy("image_id", color.luminance_segment(F.col("L"), 5).alias("segment")).agg(F.count("*").alias("n"))
    return dist.exclusive_offsets(counts, ["image_id"], "segment")


@query(f"WITH {LAB_SQL} SELECT image_id, x, y, {_SEG} AS segment, CAST(row_number() OVER (PARTITION BY image_id, {_SEG} ORDER BY y, x) AS INT) AS position FROM labs")
def segment_positions(spark: SparkSession, d: str) -> DataFrame:
    s = labs(spark, d).select("image_id", "x", "y", color.luminance_segment(F.col("L"), 5).alias("segment"))
    return dist.position_in(s, ["image_id", "segment"], ["y", "x"])


# Transfers


@query(_transfer_sql(**{c: _moved(c) for c in CHANNELS}))
def moment_transfer(spark: SparkSession, d: str) -> DataFrame:
    return _out(tr.moment_transfer(*content_and_reference(spark, d)))


@query(_transfer_sql(a=_moved("a"), b=_moved("b")))
def selective_transfer(spark: SparkSession, d: str) -> DataFrame:
    return _out(tr.moment_transfer(*content_and_reference(spark, d), channels=("a", "b")))


_MASKED = "(SELECT c.*, coalesce(m, 0) AS m FROM content c LEFT JOIN mask USING (image_id, x, y))"


@query(
    f"""WITH {LAB_SQL}{MASK_SQL.format('content')}, cm AS {_MASKED} SELECT image_id, x, y, round(L, 4) + 0.0 AS L, round(a * (1 - m) + {_moved('a')} * m, 4) + 0.0 AS a, round(b * (1 - m) + {_moved('b')} * m, 4) + 0.0 AS b
FROM cm JOIN {_stats('cm', 'c', 'image_id', 'WHERE m > 0.5')} USING (image_id) CROSS JOIN {_stats('reference', 'r')}"""
)
def masked_transfer(spark: SparkSession, d: str) -> DataFrame:
    content, reference = content_and_reference(spark, d)
    return _out(tr.masked_transfer(content, reference, mask(content)))


_SIDES = PAIRS_SQL + ", lr AS (SELECT l.*, r.L AS oL, r.a AS oa, r.b AS ob FROM left_ l JOIN right_ r USING (image_id, x, y))"
_W = {"L": 0.3, "a": 0.5, "b": 0.8}


@query(f"WITH {_SIDES} SELECT image_id, x, y, " + ", ".join(f"round({c} * (1 - {w}::DOUBLE) + o{c} * {w}::DOUBLE, 4) + 0.0 AS {c}" for c, w in _W.items()) + " FROM lr")
def pixel_lerp(spark: SparkSession, d: str) -> DataFrame:
    return _out(tr.pixel_lerp(*pairs(spark, d), _W))


@query(f"WITH {_SIDES}{MASK_SQL.format('left_')} SELECT image_id, x, y, " + ", ".join(f"round(CASE WHEN m > 0 THEN {c} * 0.4::DOUBLE + o{c} * 0.6::DOUBLE ELSE {c} END, 4) + 0.0 AS {c}" for c in CHANNELS) + " FROM lr LEFT JOIN mask USING (image_id, x, y)")
def masked_lerp(spark: SparkSession, d: str) -> DataFrame:
    left, right = pairs(spark, d)
    return _out(tr.masked_lerp(left, right, mask(left), 0.6))


def _blended(c: str, w: float) -> str:
    m, s = f"(c_m_{c} * {1 - w} + r_m_{c} * {w})", f"(c_s_{c} * {1 - w} + r_s_{c} * {w})"
    return f"(CASE WHEN c_s_{c} < 1e-6 THEN {c} + {m} - c_m_{c} ELSE ({c} - c_m_{c}) * {s} / c_s_{c} + {m} END)"


@query(_transfer_sql(**{c: _blended(c, 0.25) for c in CHANNELS}))
def moment_blend(spark: SparkSession, d: str) -> DataFrame:
    return _out(tr.moment_blend(*content_and_reference(spark, d), 0.25))


@query(_transfer_sql(**{c: f"{c} * (1 - {w}::DOUBLE) + {_moved(c)} * {w}::DOUBLE" for c, w in _W.items()}))
def weighted_transfer(spark: SparkSession, d: str) -> DataFrame:
    return _out(tr.weighted_transfer(*content_and_reference(spark, d), _W))


@query(
    f"WITH {_SIDES} SELECT image_id, x, y, "
    + ", ".join(f"round({c} * (1 - {w}::DOUBLE) + (CASE WHEN r_s_{c} < 1e-6 THEN o{c} - r_m_{c} + c_m_{c} ELSE (o{c} - r_m_{c}) * c_s_{c} / r_s_{c} + c_m_{c} END) * {w}::DOUBLE, 4) + 0.0 AS {c}" for c, w in _W.items())
    + f" FROM lr JOIN {_stats('left_', 'c', 'image_id')} USING (image_id) JOIN {_stats('right_', 'r', 'image_id')} USING (image_id)"
)
def reverse_blend(spark: SparkSession, d: str) -> DataFrame:
    return _out(tr.reverse_blend(*pairs(spark, d), _W))


_ADAPT = f"""{LAB_SQL}{_quantile_cte('L')}, t11 AS (SELECT image_id, x, y, mapped AS L, {_moved('a')} AS a, {_moved('b')} AS b, c.L AS cL FROM {_JOINED.replace('content JOIN', 'content c JOIN', 1)} JOIN q_L q USING (image_id) WHERE q.value = c.L)"""


@query(f"WITH {_ADAPT} SELECT {_OUT} FROM t11")
def adaptive_transfer(spark: SparkSession, d: str) -> DataFrame:
    return _out(tr.adaptive_transfer(*content_and_reference(spark, d)))


_SEGJOIN = f"(SELECT *, {_SEG} AS segment FROM {{}})"


@query(
    f"WITH {LAB_SQL}, cs AS {_SEGJOIN.format('content')}, rs AS {_SEGJOIN.format('reference')} SELECT image_id, x, y, "
    + ", ".join(f"round({_moved(c)}, 4) + 0.0 AS {c}" for c in CHANNELS)
    + f" FROM cs JOIN {_stats('cs', 'c', 'image_id, segment')} USING (image_id, segment) LEFT JOIN {_stats('rs', 'r', 'segment')} USING (segment)"
)
def segmented_transfer(spark: SparkSession, d: str) -> DataFrame:
    return _out(tr.segmented_transfer(*content_and_reference(spark, d), lambda L: color.luminance_segment(L, 5)))


_CUT = "CASE WHEN L <= p33 THEN 0 WHEN L <= p66 THEN 1 ELSE 2 END"


@query(
    f"""WITH {LAB_SQL}, cs AS (SELECT c.*, {_CUT} AS segment FROM content c JOIN (SELECT image_id, quantile_cont(L, 0.33) AS p33, quantile_cont(L, 0.66) AS p66 FROM content GROUP BY image_id) USING (image_id)),
rs AS (SELECT r.*, {_CUT} AS segment FROM reference r CROSS JOIN (SELECT quantile_cont(L, 0.33) AS p33, quantile_cont(L, 0.66) AS p66 FROM reference)) SELECT image_id, x, y, """
    + ", ".join(f"round({_moved(c)}, 4) + 0.0 AS {c}" for c in CHANNELS)
    + f" FROM cs JOIN {_stats('cs', 'c', 'image_id, segment')} USING (image_id, segment) LEFT JOIN {_stats('rs', 'r', 'segment')} USING (segment)"
)
def tercile_transfer(spark: SparkSession, d: str) -> DataFrame:
    return _out(tr.tercile_transfer(*content_and_reference(spark, d)))


_ZONE = "CASE WHEN L < 33 THEN 's' WHEN L < 67 THEN 'm' ELSE 'h' END"
_NEAR = ", ".join(f"coalesce(avg(r.{c}), any_value(w.r_m_{c})) AS r_m_{c}, coalesce(stddev_pop(r.{c}), any_value(w.r_s_{c})) AS r_s_{c}" for c in CHANNELS)


@query(
    f"""WITH {LAB_SQL}, cz AS (SELECT *, {_ZONE} AS zone FROM content), zs AS {_stats('cz', 'c', 'image_id, zone')},
zr AS (SELECT z.image_id, z.zone, {_NEAR} FROM zs z LEFT JOIN reference r ON abs(r.L - z.c_m_L) < 15 CROSS JOIN {_stats('reference', 'r')} w GROUP BY z.image_id, z.zone) SELECT image_id, x, y, """
    + ", ".join(f"round({c} * 0.2::DOUBLE + {_moved(c)} * 0.8::DOUBLE, 4) + 0.0 AS {c}" for c in CHANNELS)
    + " FROM cz JOIN zs USING (image_id, zone) JOIN zr USING (image_id, zone)"
)
def zone_transfer(spark: SparkSession, d: str) -> DataFrame:
    return _out(tr.zone_transfer(*content_and_reference(spark, d)))


_T1 = f"t1 AS (SELECT image_id, x, y, {', '.join(f'{_moved(c)} AS {c}' for c in CHANNELS)} FROM {_JOINED})"


@query(
    f"""WITH {_ADAPT}, {_T1}, pq AS (SELECT c.image_id, c.x, c.y, c.L AS L1, c.a AS a1, c.b AS b1, t.L AS L2, t.a AS a2, t.b AS b2, m.L AS mL, m.a AS ma, m.b AS mb
 FROM content c JOIN t11 t USING (image_id, x, y) JOIN t1 m USING (image_id, x, y)), {E2000_SQL}, g AS (SELECT *, least(1, greatest(0, de / 12)) AS w FROM e7)
SELECT image_id, x, y, round(L2 * (1 - w) + mL * w, 4) + 0.0 AS L, round(a2 * (1 - w) + ma * w, 4) + 0.0 AS a, round(b2 * (1 - w) + mb * w, 4) + 0.0 AS b FROM g"""
)
def guided_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _out(tr.guided_hybrid(*content_and_reference(spark, d)))


@query(
    f"""WITH {LAB_SQL}{_quantile_cte('a')}{_quantile_cte('b')} SELECT image_id, x, y, round({_moved('L', 'c.')}, 4) + 0.0 AS L, round(qa.mapped, 4) + 0.0 AS a, round(qb.mapped, 4) + 0.0 AS b
FROM {_JOINED.replace('content JOIN', 'content c JOIN', 1)} JOIN q_a qa USING (image_id) JOIN q_b qb USING (image_id) WHERE qa.value = c.a AND qb.value = c.b"""
)
def statistics_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _out(tr.get_transfer("statistics_histogram")(*content_and_reference(spark, d)))


STEPS = [{"method": "selective", "params": {"channels": ("a", "b")}}, {"method": "blend", "params": {"weight": 0.5, "channels": ("L",)}}]


@query(_transfer_sql(L=_blended("L", 0.5), a=_moved("a"), b=_moved("b")))
def transfer_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return _out(tr.transfer_pipeline(*content_and_reference(spark, d), STEPS))


_TILES = f"""tiles AS (SELECT c.*, tx.o AS tx, ty.o AS ty FROM content c JOIN (SELECT CAST(range * 24 AS INT) AS o FROM range(3)) tx ON c.x >= tx.o AND c.x < tx.o + 32
 JOIN (SELECT CAST(range * 24 AS INT) AS o FROM range((SELECT max(y) // 24 + 1 FROM content))) ty ON c.y >= ty.o AND c.y < ty.o + 32),
w AS (SELECT *, least(1.0::DOUBLE, (x - tx + 1) / 9.0::DOUBLE, (32 - x + tx) / 9.0::DOUBLE) * least(1.0::DOUBLE, (y - ty + 1) / 9.0::DOUBLE, (32 - y + ty) / 9.0::DOUBLE) AS w
 FROM tiles JOIN {_stats('tiles', 'c', 'image_id, tx, ty')} USING (image_id, tx, ty) CROSS JOIN {_stats('reference', 'r')})"""


@query(f"WITH {LAB_SQL}, {_TILES} SELECT image_id, x, y, " + ", ".join(f"round(sum({_moved(c)} * w) / sum(w), 4) + 0.0 AS {c}" for c in CHANNELS) + " FROM w GROUP BY image_id, x, y")
def tiled_transfer(spark: SparkSession, d: str) -> DataFrame:
    return _out(tr.tiled_transfer(*content_and_reference(spark, d)))


AREAS = [((50.0, 20.0, 10.0), 40.0, {"L": 0.2, "a": 0.9, "b": 0.9}), ((70.0, -20.0, 30.0), 35.0, {"L": 0.5, "a": 0.4, "b": 0.6})]


def _area_sql(c: str) -> str:
    out = c
    for t, tol, w in AREAS:
        out = f"CASE WHEN sqrt(pow(L - {t[0]}, 2) + pow(a - ({t[1]}), 2) + pow(b - {t[2]}, 2)) < {tol} THEN {c} * (1 - {w[c]}::DOUBLE) + {_moved(c)} * {w[c]}::DOUBLE ELSE {out} END"
    return out


@query(_transfer_sql(**{c: _area_sql(c) for c in CHANNELS}))
def area_transfer(spark: SparkSession, d: str) -> DataFrame:
    return _out(tr.area_transfer(*content_and_reference(spark, d), AREAS))


_CUST = "SELECT r_name AS category, c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_SUPP = "SELECT r_name AS category, s_acctbal AS c_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(
    f"""WITH c AS ({_CUST}), s AS ({_SUPP}), cs AS (SELECT category, avg(c_acctbal) AS cm, stddev_pop(c_acctbal) AS cd FROM c GROUP BY 1), ss AS (SELECT category, avg(c_acctbal) AS rm, stddev_pop(c_acctbal) AS rd FROM s GROUP BY 1)
SELECT category, c_custkey, round(CASE WHEN rm IS NULL THEN c_acctbal WHEN cd < 1e-6 THEN c_acctbal + rm - cm ELSE (c_acctbal - cm) * rd / cd + rm END, 4) + 0.0 AS c_acctbal FROM c JOIN cs USING (category) LEFT JOIN ss USING (category)"""
)
def category_transfer(spark: SparkSession, d: str) -> DataFrame:
    """Customers' balances restated to the suppliers' of their region."""
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    regions = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("category"))
    customers = t("customer").join(regions, F.col("c_nationkey") == F.col("n_nationkey")).select("category", "c_custkey", "c_acctbal")
    suppliers = t("supplier").join(regions, F.col("s_nationkey") == F.col("n_nationkey")).select("category", F.col("s_acctbal").alias("c_acctbal"))
    return rounded(tr.category_transfer(customers, suppliers, ["c_acctbal"]), "c_acctbal", digits=4)


_LI = ("l_quantity", "l_extendedprice", "l_discount")


@query(
    "WITH c AS (SELECT * FROM lineitem WHERE l_returnflag = 'N'), r AS (SELECT * FROM lineitem WHERE l_returnflag = 'R'), cs AS (SELECT "
    + ", ".join(f"avg({c}) AS cm_{c}, stddev_pop({c}) AS cd_{c}" for c in _LI) + " FROM c), rs AS (SELECT " + ", ".join(f"avg({c}) AS rm_{c}, stddev_pop({c}) AS rd_{c}" for c in _LI)
    + " FROM r) SELECT " + ", ".join(f"round(sum(({c} - cm_{c}) * rd_{c} / cd_{c} + rm_{c}) / count(*), 4) AS {c}_mean, round(stddev_pop(({c} - cm_{c}) * rd_{c} / cd_{c} + rm_{c}), 4) AS {c}_std" for c in _LI) + " FROM c CROSS JOIN cs CROSS JOIN rs"
)
def generic_transfer_moments(spark: SparkSession, d: str) -> DataFrame:
    """Moments of line items restated to those of returned ones."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", *_LI)
    out = tr.moment_transfer(items.filter("l_returnflag = 'N'"), items.filter("l_returnflag = 'R'"), _LI, keys=())
    return out.agg(*[f for c in _LI for f in (F.round(F.avg(c), 4).alias(f"{c}_mean"), F.round(F.stddev_pop(c), 4).alias(f"{c}_std"))])


_CORR = f"sim AS (SELECT corr(v, o) AS r_ FROM (SELECT unnest([l.L, l.a, l.b]) AS v, unnest([r.L, r.a, r.b]) AS o FROM left_ l JOIN right_ r USING (image_id, x, y)))"


@query(f"WITH {PAIRS_SQL}, {_CORR} SELECT image_id, x, y, " + ", ".join(f"round({c} * (1 - w{c}) + {_moved(c)} * w{c}, 4) + 0.0 AS {c}" for c in CHANNELS) + f" FROM (SELECT *, CASE WHEN r_ > 0.8 THEN 0.3::DOUBLE WHEN r_ < 0.3 THEN 0.0 ELSE 0.6::DOUBLE END AS wL, CASE WHEN r_ > 0.8 THEN 0.5::DOUBLE WHEN r_ < 0.3 THEN 1.0 ELSE 0.8::DOUBLE END AS wa, CASE WHEN r_ > 0.8 THEN 0.5::DOUBLE WHEN r_ < 0.3 THEN 1.0 ELSE 0.8::DOUBLE END AS wb FROM {_JOINED} CROSS JOIN sim)")
def similarity_driven(spark: SparkSession, d: str) -> DataFrame:
    left, right = pairs(spark, d)
    content, reference = content_and_reference(spark, d)
    return _out(tr.similarity_driven(content, reference, quality.overall_correlation(left, right)))


# Quality


@query(
    f"""WITH {_SIDES}, pq AS (SELECT image_id, L AS L1, a AS a1, b AS b1, oL AS L2, oa AS a2, ob AS b2 FROM lr), {E2000_SQL} SELECT image_id, round(avg(de), 4) AS mean_delta_e, round(max(de), 4) AS max_delta_e, """
    + ", ".join(f"round(corr({c}1, {c}2), 4) AS corr_{c}, round(abs(avg({c}1) - avg({c}2)), 4) AS mean_diff_{c}, round(abs(stddev_pop({c}1) - stddev_pop({c}2)), 4) AS std_diff_{c}" for c in CHANNELS)
    + " FROM e7 GROUP BY image_id"
)
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.report(*pairs(spark, d))


@query(
    f"""WITH {_SIDES}, pq AS (SELECT image_id, L AS L1, a AS a1, b AS b1, oL AS L2, oa AS a2, ob AS b2 FROM lr), {E2000_SQL}
SELECT image_id, NOT (avg(de) > 50 OR corr(L1, L2) < 0.5 OR corr(a1, a2) < 0.5 OR corr(b1, b2) < 0.5) AS passed FROM e7 GROUP BY image_id"""
)
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return quality.gate(quality.report(*pairs(spark, d))).select("image_id", "passed")


@query(f"WITH {_SIDES}, pq AS (SELECT image_id, L AS L1, a AS a1, b AS b1, oL AS L2, oa AS a2, ob AS b2 FROM lr), {E2000_SQL}, s AS (SELECT image_id, avg(de) AS m, max(de) AS x, corr(L1, L2) AS c, bool_and(abs(L1 - L2) < 1 AND abs(a1 - a2) < 1 AND abs(b1 - b2) < 1) AS same FROM e7 GROUP BY image_id) SELECT image_id, array_to_string(list_filter([CASE WHEN same THEN 'no effect' END, CASE WHEN m > 50 THEN 'mean difference very large' END, CASE WHEN x > 100 THEN 'largest difference very large' END, CASE WHEN c < 0.7 THEN 'structure lost' END], lambda v: v IS NOT NULL), ';') AS issues, array_to_string(list_filter([CASE WHEN m < 2 THEN 'hardly any change' END, CASE WHEN c >= 0.7 AND c < 0.85 THEN 'structure weakened' END], lambda v: v IS NOT NULL), ';') AS warnings, array_to_string(list_filter([CASE WHEN same THEN 'raise the weights' END, CASE WHEN m > 50 THEN 'lower the weights' END, CASE WHEN x > 100 THEN 'limit the transfer to a mask' END, CASE WHEN c < 0.7 THEN 'transfer a and b only' END, CASE WHEN m < 2 AND NOT same THEN 'raise the weights' END, CASE WHEN c >= 0.7 AND c < 0.85 THEN 'lower the weight of L' END], lambda v: v IS NOT NULL), ';') AS suggestions FROM s")
def diagnose_transfer(spark: SparkSession, d: str) -> DataFrame:
    return quality.diagnose(*pairs(spark, d)).select("image_id", F.array_join("issues", ";").alias("issues"), F.array_join("warnings", ";").alias("warnings"), F.array_join("suggestions", ";").alias("suggestions"))


@query(f"WITH {_SIDES} SELECT image_id, image_id = 'p0' AS over_transfer FROM lr GROUP BY image_id HAVING count(*) FILTER (L IS NULL) = 0")
def over_transfer(spark: SparkSession, d: str) -> DataFrame:
    """A result that is 3 off its target everywhere is too like it; one that is 6 off is not."""
    left, right = pairs(spark, d)
    moved = right.select("image_id", "x", "y", *[(F.col(c) + F.when(F.col("image_id") == "p0", 3.0).otherwise(6.0)).alias(c) for c in CHANNELS])
    return quality.diagnose(left, moved, right).select("image_id", F.array_contains("warnings", "result very similar to target").alias("over_transfer"))


@query(f"WITH {_SIDES.split(', lr AS')[0]} SELECT count(*) FILTER (l.x IS NULL OR r.x IS NULL) = 0 AS same_shape FROM left_ l FULL JOIN right_ r ON l.image_id = r.image_id AND l.x = r.x AND l.y = r.y")
def same_shape(spark: SparkSession, d: str) -> DataFrame:
    return tr.same_shape(*pairs(spark, d), ["image_id", "x", "y"])


_BACK = " + ".join(f"abs({o} - {channel_sql(row)})" for o, row in zip(("r", "g", "bl"), color.XYZ_TO_RGB, strict=True))


@query(f"WITH {LAB_SQL}, e AS (SELECT *, ({_BACK}) / 3.0 AS off FROM labs) SELECT image_id, count(*) AS n, count(*) FILTER (L < 0 OR L > 100.0001 OR a < -128 OR a > 127 OR b < -128 OR b > 127) AS out_of_range, avg(off) > 5 OR max(off) > 20 AS round_trip_off FROM e GROUP BY image_id")
def diagnose_conversion(spark: SparkSession, d: str) -> DataFrame:
    return quality.diagnose_conversion(pixels(spark, d))


@query(
    f"""WITH {PIXELS_SQL}, s AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn, max(x) OVER (PARTITION BY image_id) AS ex, max(y) OVER (PARTITION BY image_id) AS ey FROM pixels),
v AS (SELECT image_id, (r + g + b) / 3.0 AS grey, x = 0 OR y = 0 OR x = ex OR y = ey AS edge, CASE WHEN mx = 0 THEN 0 ELSE (mx - mn)::DOUBLE / mx END AS sat, r * 0.2989::DOUBLE + g * 0.5870::DOUBLE + b * 0.1140::DOUBLE AS luma FROM s),
t AS (SELECT image_id, avg(CASE WHEN edge THEN grey END) > 240 AS white_background, stddev_pop(luma) > 30 AS contrast, avg(sat) > 0.1 AND avg(sat) < 0.8 AS saturation FROM v GROUP BY image_id) SELECT *, contrast AND saturation AS passed FROM t"""
)
def catalog_validation(spark: SparkSession, d: str) -> DataFrame:
    return quality.validate_catalogue(pixels(spark, d))


@query(f"WITH {PIXELS_SQL}, p AS (SELECT image_id, x, y, r, g, b FROM pixels) SELECT CASE l.image_id WHEN 'img0' THEN 'p0' ELSE 'p1' END AS image_id, round(avg(sqrt(pow(l.r - o.r, 2) + pow(l.g - o.g, 2) + pow(l.b - o.b, 2))), 4) AS colour_difference FROM p l JOIN p o ON l.x = o.x AND l.y = o.y AND (l.image_id, o.image_id) IN (('img0', 'img1'), ('img2', 'img3')) GROUP BY 1")
def colour_difference(spark: SparkSession, d: str) -> DataFrame:
    p = pixels(spark, d).withColumn("side", F.col("image_id").isin("img1", "img3")).withColumn("image_id", F.when(F.col("image_id").isin("img0", "img1"), "p0").otherwise("p1"))
    return quality.colour_difference(p.filter(~F.col("side")), p.filter("side"))


# Stencils

FULL_SQL = PIXELS_SQL + ", f AS (SELECT image_id, x, y, r::DOUBLE AS v FROM pixels)"


def values(spark: SparkSession, d: str) -> DataFrame:
    """The red channel of every pixel; the last row of an image may be shorter than the others."""
    return pixels(spark, d).select("image_id", "x", "y", F.col("r").cast("double").alias("v"))


_NINE = """ h AS (SELECT *, coalesce(lag(v) OVER r, v) AS l, coalesce(lead(v) OVER r, v) AS m FROM f WINDOW r AS (PARTITION BY image_id, y ORDER BY x)),
n AS (SELECT *, coalesce(lag(l) OVER c, l) AS a0, coalesce(lag(v) OVER c, v) AS a1, coalesce(lag(m) OVER c, m) AS a2, coalesce(lead(l) OVER c, l) AS c0, coalesce(lead(v) OVER c, v) AS c1, coalesce(lead(m) OVER c, m) AS c2
 FROM h WINDOW c AS (PARTITION BY image_id, x ORDER BY y)), g AS (SELECT *, sqrt(pow((a2 + 2*m + c2) - (a0 + 2*l + c0), 2) + pow((c0 + 2*c1 + c2) - (a0 + 2*a1 + a2), 2)) AS grad FROM n)"""


@query(f"WITH {FULL_SQL}, {_NINE} SELECT image_id, x, y, round(grad, 4) AS gradient FROM g")
def sobel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stencil.gradient(values(spark, d)).select("image_id", "x", "y", "gradient"), "gradient", digits=4)


@query(f"WITH {FULL_SQL}, {_NINE} SELECT image_id, x, y, list_sort([a0, a1, a2, l, v, m, c0, c1, c2])[5] AS median FROM n")
def median3(spark: SparkSession, d: str) -> DataFrame:
    return stencil.median3(values(spark, d))


@query(f"WITH {FULL_SQL}, {_NINE}, e AS (SELECT image_id, x, y FROM g WHERE grad > 700) SELECT DISTINCT f.image_id, f.x, f.y FROM f JOIN e ON f.image_id = e.image_id AND abs(f.x - e.x) + abs(f.y - e.y) <= 2 AND f.x BETWEEN e.x - 2 AND e.x + 2")
def dilate(spark: SparkSession, d: str) -> DataFrame:
    full = values(spark, d)
    return stencil.dilate(stencil.gradient(full).filter("gradient > 700"), full, 2)


def _blur_sql(sigma: float, radius: int) -> str:
    w = stencil.gaussian_weights(sigma, radius)
    term = lambda c, by: " + ".join(f"{k!r} * " + ("coalesce(" + ("lag" if i < radius else "lead") + f"({c}, {abs(i - radius)}) OVER {by}, " + (f"first_value({c}) OVER {by}" if i < radius else f"last_value({c}) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)") + ")" if i != radius else c) for i, k in enumerate(w))
    return f"bx AS (SELECT image_id, x, y, v, {term('v', 'wx')} AS u FROM f WINDOW wx AS (PARTITION BY image_id, y ORDER BY x)), bl AS (SELECT image_id, x, y, v, {term('u', 'wy')} AS blur FROM bx WINDOW wy AS (PARTITION BY image_id, x ORDER BY y))"


@query(f"WITH {FULL_SQL}, {_blur_sql(1.0, 2)} SELECT image_id, x, y, round(blur, 4) AS blur FROM bl")
def gaussian_blur(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stencil.gaussian_blur(values(spark, d), 1.0, 2).select("image_id", "x", "y", "blur"), "blur", digits=4)


@query(
    f"""WITH {FULL_SQL}, {_NINE}, {_blur_sql(1.0, 2)}, e AS (SELECT image_id, x, y FROM g WHERE grad > 700),
dl AS (SELECT DISTINCT f.image_id, f.x, f.y FROM f JOIN e ON f.image_id = e.image_id AND abs(f.x - e.x) + abs(f.y - e.y) <= 1)
SELECT b.image_id, b.x, b.y, round(CASE WHEN dl.x IS NULL THEN v ELSE v * 0.4::DOUBLE + blur * 0.6::DOUBLE END, 4) AS v FROM bl b LEFT JOIN dl USING (image_id, x, y)"""
)
def edge_blend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stencil.edge_blend(values(spark, d), 700.0, 1, 1.0, 2, 0.6), "v", digits=4)
