import math
import random

import numpy as np

from tessera.llm import vectors as vs

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(n=600, d=12, seed=2):
    rng = random.Random(seed)
    out = [(i, [rng.gauss(0, 1) for _ in range(d)], 0) for i in range(n)]
    for i in range(100, 300):
        out[i] = (i, [0.5] * d, 0)
    out[5] = (5, None, 0)
    out[20] = (20, [float("nan")] + [0.1] * (d - 1), 0)
    out[7] = (7, [None] + [0.1] * (d - 1), 0)
    out[40] = (40, [0.0] * d, 0)
    out[60] = (60, [float("inf")] * d, 0)
    return out + [(None, [1.0] * d, 0), (9999, [], 0)]


def good(v):
    return v and all(x is not None and math.isfinite(x) for x in v)


def as_table(out):
    found = {}
    for r in out:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in found.items()}


def test_exact_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vs, "BLOCK_ROWS", 150)
    monkeypatch.setattr(vs, "BLOCK_QUERIES", 10)
    monkeypatch.setattr(vs, "AT_ONCE", 7)
    data = rows()
    got = as_table(vs.exact_top_k(spark.createDataFrame(data, SCHEMA)).collect())
    x = {i: [math.floor(64 * float(np.float32(c))) for c in v] for i, v, _ in data if i is not None and good(v)}
    assert set(got) == {i for i in x if i % 20 == 0}
    for q, found in got.items():
        want = sorted(((-sum(a * b for a, b in zip(x[q], v, strict=True)), i) for i, v in x.items() if i != q))[:20]
        assert found == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def searched(lists, q, k, own=None, floor=None):
    q = np.array(q)
    none = np.full(len(q), -1)
    query, row, score = lists.search(q, none if own is None else np.array(own), np.full(len(q), -np.inf) if floor is None else np.array(floor), k)
    return [[(int(s), int(lists.ids[r])) for j, r, s in zip(query, row, score, strict=True) if j == i] for i in range(len(q))]


def test_threshold_stops_early(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (4000, 4))
    x[17] = [900, 900, 900, 900]
    lists = vs.SortedLists(np.arange(4000), np.arange(4000), x)
    assert searched(lists, [[1, 1, 1, 1]], 1) == [[(3600, 17)]]
    lists.lists = lists.lists.copy()
    lists.lists[400:3600] = 17  # the middle of the lists is never read
    assert searched(lists, [[1, 1, 1, 1], [1, 0, 0, 2]], 1) == [[(3600, 17)], [(2700, 17)]]


def test_batches_ties_floors_and_zero_queries():
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (300, 3))
    lists = vs.SortedLists(np.arange(300) + 1000, np.arange(300) // 2, x)
    q = rng.integers(-2, 3, (40, 3))
    q[3] = 0
    own = rng.integers(1000, 1300, 40)
    got = searched(lists, q, 7, own)
    for i in range(40):
        want = sorted(((-int(x[r] @ q[i]), r // 2) for r in range(300) if r + 1000 != own[i]))[:7]
        assert got[i] == [(-s, j) for s, j in want]
        floor = got[i][-1][0] + 1
        assert searched(lists, q[i : i + 1], 7, own[i : i + 1], [floor])[0] == [h for h in got[i] if h[0] >= floor]


def test_large_components_stay_exact():
    x = np.array([[2**40, 1], [2**40, 2], [-(2**40), 5]])
    assert searched(vs.SortedLists(np.arange(3), np.arange(3), x), [[2**40, 3]], 2) == [[(2**80 + 6, 1), (2**80 + 3, 0)]]


def test_repeated_ids_and_dimensions(spark):
    """Each row of a repeated id is a query, and a candidate of the others; queries meet rows of their dimension only."""
    rng = random.Random(9)
    data = [(0, [1.0, 2.0], 0)] * 2 + [(20, [1.0, 1.0], 0)] + [(100 + i, [rng.gauss(0, 1) for _ in range(3)], 0) for i in range(41)]
    for search in (vs.exact_top_k, vs.forest_top_k):
        got = [(r.query_id, r.rank, r.vec_id) for r in search(spark.createDataFrame(data, SCHEMA).repartition(3), k=3).collect()]
        assert sorted(g for g in got if g[0] < 100) == [(0, 1, 0), (0, 1, 0), (0, 2, 20), (0, 2, 20), (20, 1, 0), (20, 2, 0)]
        assert sorted({g[0] for g in got if g[0] >= 100}) == [100, 120, 140] and all(g[2] >= 100 for g in got if g[0] >= 100)
        assert len(got) == 6 + 9


def test_forest_recall_and_scores(spark):
    data = rows(2000, 16)
    got = as_table(vs.forest_top_k(spark.createDataFrame(data, SCHEMA)).collect())
    x = {i: np.array(v, np.float32).astype(float) for i, v, _ in data if i is not None and good(v) and any(v)}
    assert set(got) == {i for i in x if i % 20 == 0}
    hits = total = 0
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, len(found) + 1)) and q not in {f[1] for f in found}
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        for _, i, s in found:
            assert abs(s - float(x[q] @ x[i])) < 1e-9
        kth = sorted((float(x[q] @ v) for i, v in x.items() if i != q), reverse=True)[19]
        hits += sum(s >= kth - 1e-9 for _, _, s in found)
        total += 20
    assert hits / total >= 0.9


def test_forest_scores_a_falling_share_of_rows():
    shares = []
    for n in (2000, 20000):
        rng = np.random.default_rng(5)
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        forest = vs.Forest(x, n)
        leaves, q = forest.leaves(x), x[:60]
        sizes = np.bincount(leaves.ravel(), minlength=vs.TREES * 2**forest.levels)
        seen = np.stack([v[leaves].any(axis=1) for v in forest.visits(q, sizes, n, vs.SHARE * n**-vs.POWER, 20)])
        scores = q @ x.T
        scores[np.arange(60), np.arange(60)] = -np.inf
        near = np.argsort(-scores, axis=1)[:, :20]
        assert np.take_along_axis(seen, near, axis=1).mean() >= 0.9
        shares.append(seen.mean())
    assert shares[0] < 0.75 and shares[1] < 0.52


def test_few_rows_and_empty_tables(spark):
    for search in (vs.exact_top_k, vs.forest_top_k):
        assert search(spark.createDataFrame([], SCHEMA)).count() == 0
        few = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 1.0], 1)], SCHEMA)
        assert [(r.rank, r.vec_id) for r in search(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]
        clash = spark.createDataFrame([(0, [1.0], "a", 5), (3, [2.0], "b", 6)], "vec_id long, embedding array<float>, score string, rank int")
        assert [r.vec_id for r in search(clash).collect()] == [3]
