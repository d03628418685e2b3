import random
from pathlib import Path

import numpy as np
import pytest

from tessera.llm import near_duplicates as nd
from tessera.llm import scratch
from tessera.llm.components import connected_components

SCHEMA = "doc_id long, text string"


def shingle_set(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed=4, groups=12, hot=90):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    texts = []
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 250))]
        for _ in range(hot if g == 0 else rng.randint(1, 8)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words) + rng.choice(["", " ", "\n"]))
    for _ in range(60):
        texts.append(passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12))))
    texts += [None, "", " \n", "one", "One", "one two three", "one  TWO three", "é É", "a b c d", "a b c d", "x " * 400]
    rng.shuffle(texts)
    return list(enumerate(texts))


def result(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    key = lambda r: (r[0] is None, r)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nd.link_documents(df, **options).collect()), key=key)


@pytest.mark.parametrize(("tile", "flush"), [(64, nd.FLUSH), (5, nd.FLUSH), (5, 40)])
def test_against_brute_force(spark, monkeypatch, tile, flush):
    """Also with tiles that are cut inside a task, as a shingle with most of its rows is."""
    monkeypatch.setattr(nd, "TILE", tile)
    monkeypatch.setattr(nd, "FLUSH", flush)
    monkeypatch.setattr(nd, "SUB_TILE", 20)
    rows = corpus()
    want = brute(rows)
    assert result(spark, rows) == sorted(want)
    assert len({c for _, _, c in want}) < len(rows) - 50


def test_repeats_nulls_and_empty(spark):
    rows = [(None, "a b c d e")] * 20 + [(3, "a b c d e"), (3, "a b c d e"), (4, None), (None, "q r s t"), (5, "")]
    got = result(spark, rows)
    assert [(d, c) for d, _, c in got if d is not None] == [(3, 3), (3, 3), (4, 4), (5, 5)]
    assert sorted(c for d, _, c in got if d is None and c is not None) == [3] * 20
    assert result(spark, []) == []


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(9000)}" for _ in range(150_000))
    rows = [(1, long, 5, "a", 7), (2, long + " end", 6, "b", 8), (3, "other words stand here", 7, "c", 9)]
    df = spark.createDataFrame(rows, SCHEMA + ", node int, key string, n int")
    got = sorted((r.doc_id, r.component_id) for r in nd.link_documents(df).collect())
    assert got == [(1, 1), (2, 1), (3, 3)]


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 900), dtype=np.uint64))
        b = np.unique(np.r_[rng.choice(a, min(len(a), int(rng.integers(1, 900)))), rng.integers(0, 2**63, rng.integers(1, 900), dtype=np.uint64)])
        most = nd.bound([nd.bitmap(a)], [nd.bitmap(b)], np.array([len(a)]), np.array([len(b)]))[0]
        assert most >= len(np.intersect1d(a, b))


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)]
    out = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {out[i] for i in range(41)} == {0} and out[100] == out[101] == 100


def test_intermediate_tables_can_be_removed(spark, tmp_path):
    df = scratch.materialise(spark.range(5).toDF("n"), "some")
    assert df.count() == 5
    path = scratch._WRITTEN[-1].split("://")[1]
    assert Path(path).exists() and scratch.remove_tables(spark) >= 1 and not Path(path).exists() and not scratch._WRITTEN


def test_pairs_in_parts():
    """All pairs within reach, in parts of few of them, so that their number in a task's tiles is not its memory."""
    n = np.sort(np.random.default_rng(3).integers(10, 30, 200)).reshape(20, 10).ravel()
    ends = np.repeat(np.arange(10, 201, 10), 10)
    parts = list(nd._window_pairs(n, ends, 80, most=25))
    assert len(parts) > 5 and all(len(i) <= 25 for i, _ in parts)
    found = [(a, b) for i, j in parts for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert found == [(a, b) for a in range(200) for b in range(a + 1, ends[a]) if 80 * n[b] <= 100 * n[a]]


def test_signatures_and_arrays_are_shuffled_once(spark, monkeypatch):
    """Both joins of pairs to signatures share one shuffle, and arrays are grouped and joined by one key."""
    plans = {}

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return scratch.materialise(df, name)

    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(30)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t + " end" * (i // 20)) for i, t in enumerate(texts * 2)], "doc_id long, text string")
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    monkeypatch.setattr(nd, "materialise", noted)
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        assert len({r.component_id for r in nd.link_documents(docs).collect()}) == 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plans["bitmap-pairs"].count("ReusedExchange") == 1
    assert plans["shingle-arrays"].count("Exchange hashpartitioning(key") == plans["shingle-arrays"].count("Exchange hashpartitioning") == 2
