import zlib
from collections import defaultdict

from tessera.llm.sharding import shard_by_bytes

SCHEMA = "doc_id long, text string"


def check(spark, rows, shards=24, parts=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    out = shard_by_bytes(df, shards).collect()
    assert len(out) == len(rows)
    total, largest = 0, max((len((t or "").encode()) + 8 for _, t in rows), default=0)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
        total += r.size
    for s, members in by.items():
        assert 0 <= s < shards
        assert sorted(m.slot for m in members) == list(range(len(members)))
        if total > shards * largest:
            assert abs(sum(m.size for m in members) - total / shards) <= 2 * largest + total / shards / 16
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in out) == want
    return by


def test_balanced(spark):
    by = check(spark, [(i, "ä" * (i % 97)) for i in range(3000)])
    assert len(by) == 24


def test_hot_group_is_split_and_small_groups_stay(spark):
    rows = [(i, "same text for a third of the rows") for i in range(1000)] + [(i, f"text {i // 2}") for i in range(1000, 3000)]
    by = check(spark, rows)
    where = defaultdict(set)
    text = dict(rows)
    for s, members in by.items():
        for m in members:
            where[text[m.doc_id]].add(s)
    assert len(where.pop("same text for a third of the rows")) > 4
    assert max(len(v) for v in where.values()) == 1


def test_nulls_repeats_and_empty(spark):
    check(spark, [(None, None)] * 30 + [(5, "")] * 30 + [(6, "x" * 5000)])
    assert shard_by_bytes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_very_long_text(spark):
    by = check(spark, [(1, "é" * 400_000), *[(i, f"text {i}") for i in range(2, 400)]])
    (shard,) = {s for s, members in by.items() for m in members if m.doc_id == 1}
    assert max(m.size for m in by[shard]) == 800_008


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 5, "k"), (2, "b", 6, "l")], SCHEMA + ", size long, shard string")
    assert sorted(r.doc_id for r in shard_by_bytes(df, 2).collect()) == [1, 2]
