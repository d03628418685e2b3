import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import color
from tessera.functions import text as tx
from tessera.operators import corpus, palette, parameters, stencil, transfer
from tessera.operators import distribution as dist
from tessera.operators.difference import with_delta_e2000
from tessera.plans import pixel_tables

LAB = "L double, a double, b double"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def point(L, a, b):
    return F.struct(F.lit(float(L)).alias("L"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"))


@pytest.mark.parametrize(
    ("rgb", "lab"),
    [((0, 0, 0), (0, 0, 0)), ((255, 255, 255), (100, 0, 0)), ((255, 0, 0), (53.24, 80.09, 67.20)), ((0, 255, 0), (87.74, -86.18, 83.18)), ((0, 0, 255), (32.30, 79.19, -107.86))],
)
def test_known_lab_values_and_round_trip(spark, rgb, lab):
    got = value(spark, color.rgb_to_lab(*map(F.lit, rgb)))
    assert tuple(got) == pytest.approx(lab, abs=0.1)
    back = value(spark, color.lab_to_rgb(*[F.lit(v) for v in got]))
    assert tuple(back) == pytest.approx(rgb, abs=1)


@pytest.mark.parametrize(
    ("p", "q", "want"),
    [((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 3.1571, -77.2803), (50, 0, -82.7485), 2.8615), ((50, 2.8361, -74.0200), (50, 0, -82.7485), 3.4412), ((50, -1.3802, -84.2814), (50, 0, -82.7485), 1.0), ((50, -1.1848, -84.8006), (50, 0, -82.7485), 1.0), ((50, 0, 0), (50, 0, 0), 0.0)],
)
def test_ciede2000(spark, p, q, want):
    one = spark.createDataFrame([(*map(float, p), *map(float, q))], "L double, a double, b double, L2 double, a2 double, b2 double")
    out = with_delta_e2000(one, "Lab", ("L2", "a2", "b2"))
    assert out.columns[-1] == "delta_e" and out.first().delta_e == pytest.approx(want, abs=1e-4)


def pixels(spark, rows):
    return spark.createDataFrame([(i, k % 4, k // 4, *map(float, v)) for i, vs in rows.items() for k, v in enumerate(vs)], f"image_id string, x int, y int, {LAB}")


def test_moment_transfer_takes_the_moments(spark):
    content = pixels(spark, {"c": [(10, 1, 2), (20, 5, 2), (40, 9, 2), (80, 3, 2)]})
    reference = pixels(spark, {"r": [(50, -5, 7), (60, 5, 9), (55, 0, 20)]})
    out = transfer.moment_transfer(content, reference)
    got = out.agg(*[f(c) for c in "Lab" for f in (F.avg, F.stddev_pop)]).first()
    want = reference.agg(*[f(c) for c in "Lab" for f in (F.avg, F.stddev_pop)]).first()
    assert list(got)[:4] == pytest.approx(list(want)[:4])
    assert got[4] == pytest.approx(want[4]) and got[5] == pytest.approx(0)  # a flat channel is only shifted


def test_quantile_transfer_is_monotone(spark):
    content = pixels(spark, {"c": [(v, 0, 0) for v in (1, 5, 2, 9, 9, 4)]})
    reference = pixels(spark, {"r": [(v, 0, 0) for v in (100, 10, 50, 60)]})
    out = [r.v for r in transfer.quantile_transfer(content, reference, ["L"]).join(content.select("x", "y", F.col("L").alias("before")), ["x", "y"]).orderBy("before").select(F.col("L").alias("v")).collect()]
    assert out == sorted(out) and min(out) >= 10 and max(out) == 100


def test_pipeline_validation(spark):
    assert transfer.validate_steps([{"method": "basic"}, {"params": {}}, {"method": "nope"}]) == ["step 1: no method", "step 2: unknown method 'nope'"]
    content = pixels(spark, {"c": [(10, 1, 2), (20, 5, 2)]})
    out = transfer.transfer_pipeline(content, content, [{"method": "basic"}, {"method": "blend", "params": {"weight": 0.5}}], intermediates=True)
    assert sorted({r.step for r in out.collect()}) == [1, 2]


def test_palette_rules(spark):
    p = spark.createDataFrame([("i", 0, 0, 10, 10, 10), ("i", 1, 0, 250, 250, 250)], schemas.PIXELS)
    mapped = palette.nearest(p, [(0, 0, 0), (0, 0, 0), (255, 255, 255)]).orderBy("x").collect()
    assert [r.idx for r in mapped] == [0, 2]
    assert palette.with_extremes([(1, 2, 3)]) == [(0, 0, 0), (1, 2, 3), (255, 255, 255)]
    for wire, reason in [("success,1,1,2,3", None), ("error,1,1,2,3", "status"), ("success,x", "count"), ("success,2,1,2,3", "length"), ("success,1,1,2,999", "value"), (None, "status")]:
        assert value(spark, palette.decode_palette(F.lit(wire)))["reason"] == reason
    with pytest.raises(ValueError):
        palette.nearest(p, [])


def test_palettes_of_few_colours(spark):
    p = spark.createDataFrame([("i", k, 0, *c) for k, c in enumerate([(255, 0, 0)] * 5 + [(0, 0, 255)] * 3)], schemas.PIXELS)
    assert sorted(palette.kmeans_palette(p, 5, seeds=(1,))) == [(0, 0, 255), (255, 0, 0)]
    assert sorted((r.r, r.g, r.b) for r in palette.median_cut_palette(p, 4).collect()) == [(0, 0, 255), (255, 0, 0)]


def test_blur_keeps_a_constant_and_reflects(spark):
    flat = spark.createDataFrame([("i", x, y, 7.0) for x in range(4) for y in range(3)], "image_id string, x int, y int, v double")
    for border in ("clamp", "reflect"):
        assert {round(r.blur, 9) for r in stencil.gaussian_blur(flat, 1.0, 2, border).collect()} == {7.0}
    step = spark.createDataFrame([("i", x, 0, float(x)) for x in range(3)], "image_id string, x int, y int, v double")
    w = stencil.gaussian_weights(1.0, 2)
    got = stencil.gaussian_blur(step, 1.0, 2, "reflect").orderBy("x").first().blur
    assert got == pytest.approx(w[0] * 1 + w[1] * 0 + w[2] * 0 + w[3] * 1 + w[4] * 2)


def test_edits(spark):
    edit = lambda t, o, n: value(spark, corpus.exact_edit(F.lit(t), F.lit(o), F.lit(n)))
    assert edit("foo bar baz bar", "bar", "qux") == "foo qux baz bar" and edit("Hello World", "hello", "Hi") is None
    lines = spark.createDataFrame([("f", 1, "alpha    beta"), ("f", 2, "gamma"), ("g", 1, "nothing alike")], "path string, line_no int, text string")
    got = {r.path: (r.line_no, r.status) for r in corpus.window_edits(lines, "alpha beta", least=0.6).collect()}
    assert got["f"] == (1, "OK") and got["g"][1] == "NO_MATCH_FOUND"
    texts = spark.createDataFrame([("f", "alpha    beta\ngamma\ndelta one\nomega one"), ("g", "nothing alike")], "path string, text string")
    edits = spark.createDataFrame([(1, "gamma", "x"), (2, "alpha   beta!", "y"), (3, "delta onne\nomega onne", "z"), (4, "omega oni", "w")], "edit_id int, old_text string, new_text string")
    for force in (False, True):
        banded = {(r.path, r.edit_id): r for r in corpus.fuzzy_edits(texts, edits, force, 0.6).collect()}
        assert (banded["f", 1].band, banded["f", 1].line_no, banded["f", 1].edited) == ("exact", 2, "alpha    beta\nx\ndelta one\nomega one")
        assert banded["f", 2].band in ("diagnose", "needs force") and banded["f", 2].line_no == 1
        block = banded["f", 3]
        assert (block.band, block.kind, block.line_no, block.applied) == ("needs force", "multi_line", 3, force)
        assert block.edited == ("alpha    beta\ngamma\nz" if force else None)
        assert banded["f", 4].band == "needs force" and banded["f", 4].kind == "single_line"
        assert not any(path == "g" for path, _ in banded)
    assert value(spark, corpus.eligibility(F.lit(b"x"), F.lit("a.txt"), F.lit(10**9))) == "FILE_TOO_LARGE"


def brute_matches(text, query, least):
    """The five best lines and blocks of a text, straight from their definition."""
    def like(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        longer = max(len(a), len(b))
        return (longer - row[-1]) / longer

    lines, wanted, out = text.split("\n"), query.split("\n"), []
    for i, line in enumerate(lines):
        for j, q in enumerate(wanted):
            if len(line.strip()) >= 3 and len(q.strip()) >= 3 and (s := like(line.strip(), q.strip())) > least:
                out.append((-s, 0, i + 1, j))
    for i in range(len(lines) - len(wanted) + 1):
        block = "\n".join(lines[i : i + len(wanted)]).strip()
        if len(wanted) > 1 and len(block) >= 10 and (s := like(block, query.strip())) > least:
            out.append((-s, 1, i + 1, 0))
    return [(("single_line", "multi_line")[k], i, round(-s, 9)) for s, k, i, _ in sorted(out)[:5]]


@pytest.mark.parametrize("least", [0.1, 0.6])
def test_best_matches_against_brute_force(spark, least):
    texts = {"f": "the quick brown fox\nthe quick brown fix\n a quick brown fox \nentirely different\nthe\n\nTHE QUICK BROWN FOX jumps", "g": "é\nquick\n  brown fox\nfox", "h": ""}
    queries = ["the quick brown fox", "entirely different!", "the quick brown fix\na quick brown fix", "fox\nfo", "quick\nbrown fox"]
    lines = corpus.lines(spark.createDataFrame(list(texts.items()), "path string, text string"))
    q = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    got = {}
    for r in corpus.best_matches(lines, q, least).orderBy("nth").collect():
        got.setdefault((r.path, r.query_id), []).append((r.kind, r.line_no, round(r.similarity, 9)))
    want = {(p, i): found for p, t in texts.items() for i, query in enumerate(queries) if (found := brute_matches(t, query, least))}
    assert got == want and len(want) >= 4


def test_positions_totals_and_quantiles_of_one_group(spark):
    """A group and a table without keys are cut into ranges; nothing depends on where."""
    rows = [("i", y, x, float((x * 7 + y * 3) % 50)) for y in range(150) for x in range(3)]
    df = spark.createDataFrame(rows, "g string, y int, x int, v double").repartition(5)
    got = {(r.y, r.x): r.position for r in dist.position_in(df, ["g"], ["y", "x"]).collect()}
    assert got == {(y, x): y * 3 + x + 1 for y in range(150) for x in range(3)}
    counts = dist.value_counts(df, [], "v")
    totals = {r.v: (r.upto, r.total, r.before) for r in dist.running_totals(counts, [], "v").collect()}
    values = sorted(v for *_, v in rows)
    known = sorted(set(values))
    assert totals == {v: (sum(w <= v for w in values), len(values), known[i - 1] if i else None) for i, v in enumerate(known)}
    cuts = dist.exact_quantiles(df, ["g"], "v", (0.33, 0.5)).first()
    assert (cuts.q0, cuts.q1) == pytest.approx((np.quantile(values, 0.33), np.quantile(values, 0.5)))


def test_mapping_over_many_entries_and_whole_pipeline(spark):
    rng = np.random.default_rng(2)
    p = spark.createDataFrame([("i", x, y, *map(int, rng.integers(0, 256, 3))) for x in range(8) for y in range(8)], schemas.PIXELS)
    entries = [tuple(map(int, e)) for e in rng.integers(0, 256, (100, 3))]
    for metric in ("rgb", "lab", "hsv"):
        got = [r.idx for r in palette.nearest(p, entries, metric).orderBy("x", "y").collect()]
        halves = [[r for r in palette.nearest(p, part, metric).withColumn("d", F.lit(0)).orderBy("x", "y").collect()] for part in (entries[:50], entries[50:])]
        assert all(i in (a.idx, b.idx + 50) for i, a, b in zip(got, *halves, strict=True))
    settings = {n: default for n, (default, *_) in parameters.LIMITS.items()}
    plain = palette.map_image(p, entries[:4], settings)
    assert {(r.r, r.g, r.b) for r in plain.collect()} <= set(entries[:4])
    full = palette.map_image(p, entries[:4], settings | {"dither": True, "preserve_extremes": True, "edge_blur": True, "median": True})
    assert full.count() == 64 and all(0 <= v <= 255 for r in full.collect() for v in (r.r, r.g, r.b))


def test_median_cut_against_lists(spark):
    rng = np.random.default_rng(6)
    colours = [tuple(map(int, c)) for c in rng.integers(0, 256, (300, 3))] + [(5, 5, 5)] * 40 + [(5, 5, 6)] * 3
    p = spark.createDataFrame([("i", n, 0, *c) for n, c in enumerate(colours)], schemas.PIXELS).repartition(4)
    boxes = [colours]
    while len(boxes) < 12:
        width = lambda box, c: max(x[c] for x in box) - min(x[c] for x in box)
        i, c = max(((i, c) for i in range(len(boxes)) for c in range(3)), key=lambda ic: (width(boxes[ic[0]], ic[1]), -ic[0], -ic[1]))
        values = sorted(x[c] for x in boxes[i])
        cut = min(max(np.median(values), values[0]), values[-1] - 1)
        boxes[i], more = [x for x in boxes[i] if x[c] <= cut], [x for x in boxes[i] if x[c] > cut]
        boxes.append(more)
    want = [(i, *(int(np.floor(np.mean([x[c] for x in box]))) for c in range(3))) for i, box in enumerate(boxes)]
    cut = palette.median_cut_palette(p, 12)
    assert sorted(tuple(r) for r in cut.collect()) == want
    assert palette.median_cut_palette(p.filter("false"), 3).count() == 0 and palette.kmeans_palette(p.filter("false"), 3) == []


def test_a_round_of_k_means(spark):
    rng = np.random.default_rng(7)
    colours = np.concatenate([rng.integers(0, 256, (200, 3)), rng.integers(90, 99, (300, 3))])
    p = spark.createDataFrame([("i", n, 0, *map(int, c)) for n, c in enumerate(colours)], schemas.PIXELS).repartition(4)
    centres = rng.uniform(0, 255, (3, 6, 3))
    new, cost = palette._kmeans_round(palette.colour_counts(p), centres)
    for r in range(3):
        far = ((colours[:, None] - centres[r][None]) ** 2).sum(axis=2)
        nearest = far.argmin(axis=1)
        assert cost[r] == pytest.approx(far.min(axis=1).sum())
        for c in range(6):
            assert new[r, c] == pytest.approx(colours[nearest == c].mean(axis=0) if (nearest == c).any() else centres[r, c])
    of = lambda entries: ((colours[:, None] - np.array(entries, float)[None]) ** 2).sum(axis=2).min(axis=1).sum()
    assert of(palette.kmeans_palette(p, 6)) <= 1.001 * min(of(palette.kmeans_palette(p, 6, seeds=(s,))) for s in (42, 45, 51))


def test_globs(spark):
    cases = [("*.py", "a/b/C.PY", True), ("src/**", "src/a/b.txt", True), ("src/*", "src/a/b.txt", False), ("*.{md,txt}", "x.md", True), (".env", "a/.env", True), ("a?.js", "ab.js", True), ("*.js", "a.jsx", False)]
    for glob, path, want in cases:
        assert value(spark, tx.matches_any(F.lit(path), [glob])) is want


def test_validation():
    class Frame:
        dtypes = [("image_id", "string"), ("x", "bigint")]

    assert schemas.validate(Frame(), schemas.PIXELS)[:2] == ["x: is bigint, not int", "y: missing"]


def test_stencils_of_all_channels_at_once(spark):
    """The same numbers as each channel by itself, over borders and gaps, with two shuffles in all, not two for each step."""
    p = pixel_tables.pixels(spark, "/root/testdata/sf0.001").filter("(x * 7 + y * 3) % 11 <> 0")
    wide = stencil.blurred_with_gradient(p.withColumn("grey", (F.col("r") + F.col("g")) / 2), ("r", "b"), "grey", 1.5)
    assert wide._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    got = {(r.image_id, r.x, r.y): r for r in wide.collect()}
    one = lambda v: p.select("image_id", "x", "y", v.cast("double").alias("v"))
    for c in ("r", "b"):
        rows = stencil.gaussian_blur(one(F.col(c)), 1.5, border="reflect").collect()
        assert len(rows) == len(got) and all(got[r.image_id, r.x, r.y][f"blur_{c}"] == r.blur and got[r.image_id, r.x, r.y][c] == r.v for r in rows)
    assert all(got[r.image_id, r.x, r.y].gradient == r.gradient for r in stencil.gradient(one((F.col("r") + F.col("g")) / 2)).collect())
    middle = {(r.image_id, r.x, r.y): r for r in stencil.medians3(p, ("r", "b")).collect()}
    for c in ("r", "b"):
        assert all(middle[r.image_id, r.x, r.y][c] == r.median for r in stencil.median3(one(F.col(c))).collect())
