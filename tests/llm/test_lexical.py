import math
import random
import re
from collections import Counter

import numpy as np

from tessera.llm import lexical as lx

SCHEMA = "doc_id long, text string"
ITEMS = "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    split = [(i, terms(t)) for i, t in docs if terms(t)]
    n, length = len(split), sum(len(t) for _, t in split)
    df = Counter(t for _, ts in split for t in set(ts))
    out = []
    for item, text in items:
        scores = []
        for doc, ts in split:
            tf, m = Counter(ts), 10 + 90 * len(ts) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(terms(text)) if tf[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank + 1, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def got(spark, docs, items, parts=4, **kw):
    d = spark.createDataFrame(docs, SCHEMA).repartition(parts)
    out = lx.rank_documents(d, spark.createDataFrame(items, ITEMS), **kw)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in out.collect()), key=repr)


def corpus(n, seed=1, words=120):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(words)] + ["Ünï", "ß9", "日本"]
    weights = [1 / (i + 1) for i in range(len(pool))]
    return [(i, " ".join(rng.choices(pool, weights, k=rng.randint(0, 60)))) for i in range(n)]


def test_same_as_brute_force(spark):
    docs = corpus(600)
    items = [(i, " ".join(random.Random(i).sample([f"W{k}" for k in range(120)], 12)) + ", ÜNÏ ß9!") for i in range(25)]
    assert got(spark, docs, items) == brute(docs, items)


def test_trees_of_many_nodes_prune_and_stay_exact(spark, monkeypatch):
    """Small leaves and blocks; copies tie in hundreds, and the smallest ids come first."""
    monkeypatch.setattr(lx, "BLOCK_DOCS", 64)
    monkeypatch.setattr(lx, "LEAF_DOCS", 2)
    docs = corpus(300) + [(1000 - i, "w7 w50 w60 copy") for i in range(300)] + [(None, "w7 w50 w60 copy")] * 3
    items = [(1, "w50 w60"), (2, "copy"), (3, "w1 w2 w3 w119"), (4, "nothing like it")]
    assert got(spark, docs, items, k=5) == brute(docs, items, k=5)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, rng.integers(0, 9))) + 40 * (i % 5) for i in range(500)]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    which = np.concatenate(rows)
    block = lx.Block(starts, which, rng.integers(1, 10**10, len(which)), 200, leaf=8)
    item = np.array([41, 44, 60, 70])
    mask = np.zeros(200, np.int64)
    bounds, exact = block.bounds([item])[:, 0], np.zeros(500, np.int64)
    most, block.most = block.most, np.full_like(block.most, 1e100)
    ball, block.most = block.bounds([item])[:, 0], most
    assert (ball >= bounds).all()
    for r in range(500):
        for t, v in zip(block.terms[block.starts[r] : block.starts[r + 1]], block.values[block.starts[r] : block.starts[r + 1]], strict=True):
            exact[r] += v * (t in item)
    at = 0
    for borders in block.borders:
        for lo, hi in zip(borders[:-1], borders[1:], strict=True):
            assert exact[lo:hi].max() <= bounds[at] <= ball[at] < 1e50
            at += 1
    found = []
    scored = block.search(item, bounds, found, list(range(500)), 3, mask)
    assert sorted((s for s, _, _ in found), reverse=True) == sorted(exact, reverse=True)[:3] and not mask.any()
    assert scored < 250


def test_several_passes_over_items(spark):
    docs = corpus(120)
    items = [(i, f"w{i} w{i + 1} w{2 * i}") for i in range(30)]
    assert got(spark, docs, items, item_bytes=60) == brute(docs, items)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "..."), (None, "a b"), (None, "a b"), (5, "a A-a\x00a"), (5, "a b c"), (6, "é" * 50_000 + " b " + "long " * 30_000)]
    items = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "é" * 50_000), (5, "long c")]
    want = brute(docs, items)
    assert got(spark, docs, items) == want and len(want) > 8
    assert got(spark, [], items) == [] and got(spark, docs, []) == []
    assert got(spark, [(1, None)], items) == []


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", 2, "x"), (2, "b", 3, "y")], SCHEMA + ", n long, score string")
    i = spark.createDataFrame([(1, "A", 7, "z")], ITEMS + ", item long, doc_id string")
    assert [tuple(r)[:3] for r in lx.rank_documents(d, i).collect()] == [(1, 1, 1)]
