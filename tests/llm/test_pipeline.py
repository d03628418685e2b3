import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessera.llm import mixing
from tessera.llm.byte_bpe import encode_documents
from tessera.llm.pii import base_spans
from tessera.llm.places import FILE, PLACE, placed
from test_mixing import size, targets
from test_near_duplicates import brute, shingle_set


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    words = {"en": "the and of house water green letter under", "de": "der und die haus wasser grün brief unter"}
    rows = []
    for i in range(160):
        lang = "en" if i % 2 else "de"
        text = " ".join(rng.choice(words[lang].split()) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(rng.randint(5, 60)))
        if i % 10 == 0:
            text += " write to jo.lee@mail.example.com or +1 (555) 010-9999"
        if i % 8 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1] or text
        rows.append((i, text, lang, "hot" if i % 3 else rng.choice(["a", "b", None]), len(text)))
    rows += [(900, None, "en", "a", 0), (901, "", "en", "a", 0), (902, "12 34", None, "a", 5)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_stages_against_brute_force(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    texts = {r[0]: r[1] for r in rows}

    told = cp.identify_stage(spark, docs, path).cache()
    assert told.columns == cp.COLUMNS
    left = sorted(r.doc_id for r in told.collect())
    assert left == [i for i, t in texts.items() if t and any(c.isalpha() for c in t)]

    single = cp.near_duplicate_stage(spark, told, path).cache()
    kept = sorted(r.doc_id for r in single.collect())
    assert kept == sorted(d for d, _, c in brute([(i, texts[i]) for i in left]) if d == c)

    masked = cp.pii_stage(spark, single, path).cache()
    for r in masked.collect():
        assert not base_spans(r.text) and r.n_chars == len(r.text)
        if not base_spans(texts[r.doc_id]):
            assert r.text == texts[r.doc_id]

    mixed = cp.mix_stage(spark, masked, path).cache()
    assert mixed.columns == cp.COLUMNS
    sizes, taken = {}, {}
    for r in masked.collect():
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    for s, t in targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= 61

    encoded = cp.encode_stage(spark, mixed, path)
    assert encoded.count() == mixed.count()
    assert encode_documents.__name__ and all(len(r.ids) == r.n_tokens > 0 for r in encoded.collect())


def test_extra_columns_are_left_out_of_the_run(spark, folder, tmp_path):
    path, rows = folder
    spark.read.parquet(f"{path}/documents.parquet").withColumns({"row": F.lit(1), "size": F.lit("x"), "component_id": F.lit(2)}).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() > 50


def words(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_near_duplicates_with_null_and_repeated_ids(spark):
    rng = random.Random(8)
    alone = [words(rng, 30) for _ in range(40)]
    copied = words(rng, 30)
    rows = [(None, t) for t in alone[:20]] + [(7, t) for t in alone[20:]] + [(None, copied), (7, copied), (3, copied + "\n"), (3, copied + "\n"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = cp.near_duplicate_stage(spark, docs, "")
    assert out.columns == cp.COLUMNS
    want = [*rows[:40], (3, copied + "\n"), (None, None), (None, "")]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(repr, want))


def test_rows_kept_by_bitmap_and_by_join(spark, monkeypatch):
    numbered = spark.range(0, 100_000, 1, 5).withColumn("row", F.monotonically_increasing_id())
    kept = numbered.filter("id % 3 = 1 OR id IN (0, 32767, 32768, 99999)").select("row")
    want = {i for i in range(100_000) if i % 3 == 1} | {0, 32767, 32768, 99999}
    assert {r.id for r in cp.keep_rows(numbered, kept).collect()} == want
    monkeypatch.setattr(cp, "BITMAPS", 0)
    assert {r.id for r in cp.keep_rows(numbered, kept).collect()} == want
    assert cp.keep_rows(numbered, kept.filter("false")).count() == 0


def test_near_duplicates_against_five_word_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for g in range(12):
        base = words(rng, 1000 if g < 6 else 200)
        rows += [base, base + " " + words(rng, 180 + 12 * g if g < 6 else rng.randint(20, 70))]
    rows += ["one two three four", "one two three  FOUR", "one two three five", "one two"]
    sets = [shingle_set(t, 5) for t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if x == group[i] else x for x in group]
    want = sorted({min(i for i, x in enumerate(group) if x == g) for g in group})
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.near_duplicate_stage(spark, docs, "").select("doc_id").collect()) == want
    assert not any(2 * g + 1 in want for g in range(6))


def test_mix_of_one_unit_over_many_parts(spark):
    """Rows of equal id, source and size share their copies whatever the part of the input that they are in."""
    rows = [(None, "one two three" if i % 2 else "four five six", "en", None, 13) for i in range(60)] + [(1, "a b", "en", "a", 3), (2, None, "en", "a", 0), (3, "", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    mixed = cp.mix_stage(spark, docs, "").collect()
    want = {None: 0, "a": 0}
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    for r in mixed:
        want[r.source] += size(r.text)
    for s, t in targets(sizes).items():
        assert abs(want[s] - t) <= 3
    times = {}
    for r in mixed:
        times[r.text] = times.get(r.text, 0) + 1
    assert times["one two three"] + times["four five six"] == round(want[None] / 3)


@pytest.mark.parametrize("stage", [name for name, _ in cp.STAGES])
def test_stages_of_empty_and_odd_tables(spark, stage):
    """An empty table gives none; very long, empty and null texts, null and repeated ids and repeated rows crash no stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    fn = dict(cp.STAGES)[stage]
    assert fn(spark, spark.createDataFrame([], schema), "").count() == 0
    long = "some words and others stand here " * 20_000
    rows = [(1, "the house of green water", "en", "a", 24)] * 3 + [(None, long, "en", None, len(long)), (None, None, None, None, None), (7, "", "de", "b", 0), (7, "das haus ist grün und alt", "de", "b", 25)]
    out = fn(spark, spark.createDataFrame(rows, schema).repartition(2), "")
    assert out.count() > 0 and (stage == "encode" or out.columns == cp.COLUMNS)


def test_run(spark, folder):
    out = cp.run(spark, folder[0])
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() > 50


def test_mix_deals_no_texts_over_tasks(spark, folder):
    """What the mix returns is read from the files of its input; only slim tables are shuffled."""
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        mixed = cp.mix_stage(spark, docs, path)
        assert "Exchange hashpartitioning" not in mixed._jdf.queryExecution().executedPlan().toString()
        assert mixed.count() > 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_mix_by_bitmap_and_by_join(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    want = sorted(map(repr, cp.mix_stage(spark, docs, "").collect()))
    assert len(set(want)) < len(want)
    monkeypatch.setattr(mixing, "BITMAPS", 0)
    assert sorted(map(repr, cp.mix_stage(spark, docs, "").collect())) == want


def test_rows_from_one_place_are_told_apart(spark, folder):
    """Of a table that repeats the rows of its files, each row has a place of its own."""
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    repeated = docs.withColumn("times", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).drop("times")
    for table in (docs, repeated, docs.limit(7).unionByName(docs)):
        found = placed(table, "test-placed")
        assert found.select(FILE, PLACE).distinct().count() == found.count() == table.count()
