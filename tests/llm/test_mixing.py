import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm.mixing import mix_copies, mix_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Share by weight, cap, and share what is over again, until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in capped]
        if not open_:
            return capped
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in open_}
        for s in over:
            capped[s] = most * sizes[s]
            left -= capped[s]


def documents(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "é", None])
        text = rng.choice([None, "", " \t\n", *[" ".join(["w"] * rng.randint(1, 60)) for _ in range(12)]])
        rows.append((i, text, "en", source, len(text or "")))
    return rows


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_taken(spark):
    rows = documents()
    out = mix_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = targets(sizes)
    taken = defaultdict(int)
    assert sorted(r.doc_id for r in out) == list(range(len(rows)))
    for r in out:
        assert r.size == size(rows[r.doc_id][1]) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= 60


def test_reruns_agree_and_partitions_do_not_matter(spark):
    df = spark.createDataFrame(documents(200), SCHEMA)
    a = {(r.doc_id, r.copies) for r in mix_copies(df).collect()}
    assert a == {(r.doc_id, r.copies) for r in mix_copies(df.repartition(7)).collect()}


def test_expected_copies_follow_the_probability(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 5)), "en", "a" if i < 40 else "b", 0) for i in range(80)]
    total = defaultdict(float)
    draws = 4
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    for seed in range(draws):
        for r in mix_copies(df, seed=seed * 1000).collect():
            total[r.doc_id] += r.copies / draws
            want = r.target / r.source_size if r.source == "b" else None
        if seed == 0:
            p = want
    mean = sum(total[i] for i in range(40, 80)) / 40
    assert mean == pytest.approx(p, abs=0.12)


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(None, "a b c", "en", "x", 5)] * 50 + [(7, None, None, None, None), (7, None, None, None, None), (8, "one", "en", "y", 3)]
    out = mix_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 53 and max(r.copies for r in out) <= 2
    assert mix_copies(spark.createDataFrame([], SCHEMA)).count() == 0
    extra = spark.createDataFrame([(1, "a", "en", "s", 1, 9, "z")], SCHEMA + ", size long, copies string")
    mixed = mix_documents(extra)
    assert mixed.columns == extra.columns


def test_mixed_documents_repeat_rows(spark):
    df = spark.createDataFrame(documents(150), SCHEMA)
    copies = {r.doc_id: r.copies for r in mix_copies(df).collect()}
    got = defaultdict(int)
    for r in mix_documents(df).collect():
        got[r.doc_id] += 1
    assert dict(got) == {k: v for k, v in copies.items() if v}


def test_a_very_long_text(spark):
    rows = [(1, "w " * 300_000, "en", "a", 600_000), (2, "w", "en", "a", 1), (3, "x y", "en", "b", 3)]
    got = {r.doc_id: (r.size, r.copies) for r in mix_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1][0] == 300_000 and all(copies <= 2 for _, copies in got.values())


def test_sources_come_near_their_targets(spark):
    """Sizes from 1 to 20,000 words: a source misses by no more than one of its smaller documents, however large the largest."""
    rng = random.Random(3)
    lengths = {s: [1, 2, 3] + [rng.choice([5, 40, 300, 2500]) + rng.randint(0, 9) for _ in range(60)] + [big] for s, big in (("a", 20_000), ("b", 7000), ("c", 500), ("d", 12_000))}
    rows = [(1000 * k + i, "w " * n, "en", s, n) for k, (s, sizes) in enumerate(lengths.items()) for i, n in enumerate(sizes)]
    for seed in (1, 2000):
        taken, target = defaultdict(int), {}
        for r in mix_copies(spark.createDataFrame(rows, SCHEMA), seed=seed).collect():
            taken[r.source] += r.copies * r.size
            target[r.source] = r.target
        assert all(abs(taken[s] - t) <= max(0.02 * t, 50) for s, t in target.items()), (dict(taken), target)


def test_one_unit_of_very_many_rows(spark):
    """A million equal rows without an id are numbered by parts of the input and share their copies."""
    hot = spark.range(1_000_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'a b' AS text", "'en' AS lang", "'hot' AS source", "3L AS n_chars")
    df = hot.unionByName(spark.createDataFrame([(i, "a b c", "en", "other", 5) for i in range(1000)], SCHEMA)).repartition(8)
    got = mix_copies(df).groupBy("source").agg(F.count("*").alias("rows"), F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most")).collect()
    assert {r.source: r.rows for r in got} == {"hot": 1_000_000, "other": 1000}
    assert all(abs(r.taken - r.target) <= 3 and r.most <= 2 for r in got)
