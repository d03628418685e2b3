"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest

from tessera.operators import palette
from tessera.plans import pixel_tables, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.3f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = db.execute(registry.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(norm(dict(zip(names, row, strict=True))[c]) for c in columns) for row in result.fetchall())
    assert sorted(tuple(norm(r[c]) for c in columns) for r in df.collect()) == want


def colours(rows):
    return {(r.r, r.g, r.b) for r in rows}


def test_palettes(spark):
    """k centres, whose cost is no worse than that of one restart; boxes of the median cut; only mapped colours before blending."""
    p = pixel_tables.pixels(spark, SF)
    points = np.array([(r.r, r.g, r.b) for r in p.select("r", "g", "b").collect()], float)
    cost = lambda centres: ((points[:, None] - np.array(list(centres), float)[None]) ** 2).sum(axis=2).min(axis=1).sum()
    best = sorted(colours(registry.QUERIES["kmeans_palette"](spark, SF).collect()))
    assert len(best) == 8 and cost(best) <= 1.01 * cost(palette.kmeans_palette(p, 8, seeds=(42,)))
    cut = registry.QUERIES["median_cut_palette"](spark, SF).collect()
    assert len(cut) == 8 and all(0 <= v <= 255 for r in cut for v in (r.r, r.g, r.b)) and cost(colours(cut)) < cost([points.mean(axis=0)])


def test_palette_pipeline(spark):
    out = registry.QUERIES["palette_pipeline"](spark, SF)
    assert out.count() == pixel_tables.pixels(spark, SF).count() and out.filter("r < 0 OR r > 255 OR g < 0 OR g > 255 OR b < 0 OR b > 255").isEmpty()


def test_similarity_and_edits(spark):
    """Ranks without gaps and falling similarities; bands that fit the similarity; what is applied is edited."""
    found = registry.QUERIES["similarity_top5"](spark, SF).collect()
    groups = {}
    for r in found:
        groups.setdefault((r.path, r.query_id), []).append((r.nth, -r.similarity))
    assert groups and all(sorted(g) == sorted(g, key=lambda x: x[1]) and [n for n, _ in sorted(g)] == list(range(1, len(g) + 1)) and len(g) <= 5 for g in groups.values())
    edits = registry.QUERIES["fuzzy_edit"](spark, SF).collect()
    assert {r.band for r in edits} >= {"exact"}
    for r in edits:
        assert r.band == "exact" or r.band == ("apply" if r.similarity >= 0.98 else "needs force" if r.similarity >= 0.85 else "diagnose")
        assert (r.edited is not None) == r.applied


def test_window_edits(spark):
    out = registry.QUERIES["window_edits"](spark, SF).collect()
    assert len(out) == 200 and {r.status for r in out} <= {"OK", "NO_MATCH", "NO_MATCH_FOUND"}


def test_edited_files(spark):
    """One text for each file in which the same edits, each for itself, are applied; accepted and rejected are all of those."""
    out = registry.QUERIES["edited_files"](spark, SF).collect()
    alone = {}
    for r in registry.QUERIES["fuzzy_edit"](spark, SF).filter("applied").collect():
        alone.setdefault(r.path, set()).add(str(r.edit_id))
    assert {r.path: {*r.accepted.split(","), *r.rejected.split(",")} - {""} for r in out} == alone and alone


def test_every_query_without_sql_is_tested():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"kmeans_palette", "median_cut_palette", "palette_pipeline", "similarity_top5", "fuzzy_edit", "window_edits", "edited_files"}


def test_statistics_histogram_reads_its_colours(spark):
    """The joins look up channels that are written, so their formulas are not worked out again for filters."""
    out = registry.QUERIES["statistics_histogram"](spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "POWER" not in plan
