import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_counts as tc

PATH = public_tokenizers.path("word_bpe_49k.json")
TRICKY = [
    None, "", " ", "Hello, World! it's we've I'll don't 'SABLE ''s 'tis x'", "a\x1cb \x1f c", "é ́ áb", "ΑΣ ΟΔΟΣ Σ", "İstanbul ǅ ß ẞ",
    "日本語 テスト 12345 ½²", "　x y\xa0z\x85w", "<|endoftext|> <|startoftext|>x", "😀😀 👩‍👩‍👧", "a" * 3000, "!?" * 500, "ab" * 700 + "'s", "\t\n\r", "x_y__z--w",
]


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def random_texts(n, seed=3):
    rng = random.Random(seed)
    pool = list("abcdefgstrevmld'' \n.,!ÉéÜß0123456789ΣσäЖж中́ ") + ["'s", "'re", " the ", "tion", "ing"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def count(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in tc.count_tokens(df, PATH, **options).collect()}


@pytest.mark.parametrize("chunk", [tc.CHUNK, 7])
def test_as_the_library(spark, chunk):
    texts = TRICKY + random_texts(400)
    plain = texts + ["a<|endoftext|>b <|ENDOFTEXT|>", "e<|startoftext|>\u0301"]
    got = count(spark, plain, chunk=chunk)
    assert [got[i].n_tokens for i in range(len(plain))] == library(plain)
    assert [got[i].n_bytes for i in range(len(plain))] == [len((t or "").encode()) for t in plain]


def test_tables_that_start_anew(monkeypatch):
    machine = tc.Transducer(PATH)
    texts = random_texts(50, seed=9)
    for name in ("MOST_TRANSITIONS", "MOST_STATES", "MOST_WORDS", "MOST_PAIRS"):
        monkeypatch.setattr(tc, name, 3)
    for t, n in zip(texts, library(texts), strict=True):
        assert tc._count(machine, [t]) == [n]


def test_transitions_emit_the_tokens_of_pieces():
    """Pieces of all lengths, also those that need many tokens, against the library; emitted numbers are never negative."""
    rng = random.Random(12)
    machine = tc.Transducer(PATH)
    pieces = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 60))) for _ in range(400)] + ["internationalization" * k for k in range(1, 9)] + ["日本語" * 30, "éèü" * 20, "a" * 999]
    for p, n in zip(pieces, library(pieces), strict=True):
        assert machine.run(p) == n
    assert len(machine.states) < len(machine.transitions) and all(t % tc.EMITTED < 60 for t in machine.transitions.values())
    before = len(machine.transitions)
    assert [machine.run(p) for p in pieces] == library(pieces) and len(machine.transitions) == before


def test_resets_and_trees_of_chunks(spark, monkeypatch):
    """Texts of many chunks with and without white space, composed over several levels."""
    rng = random.Random(13)
    monkeypatch.setattr(tc, "FAN", 3)
    pool = ["word", "It's", "we'll", "''s", "x'", "12", "3.14", "a-b", "<|endoftext|>", "<|start", "oftext|>", "é", "e\u0301", "1\u0301", "Σ", "中文", "_", "(x)", "|>", "!'s", "d'"]
    texts = ["".join(rng.choice(pool) + rng.choice(["", "", " ", "\n"]) for _ in range(300)) for _ in range(20)] + ["".join(rng.choice(pool) for _ in range(300)) for _ in range(20)] + ["ab" * 800, "7" * 900]
    got = count(spark, texts, chunk=40)
    assert [got[i].n_tokens for i in range(len(texts))] == library(texts)


def test_texts_of_ten_megabytes(spark):
    rng = random.Random(14)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 12))) for _ in range(4000)]
    texts = [" ".join(rng.choice(words) for _ in range(1_300_000)), "".join(rng.choice(words) + rng.choice("0123456789-") for _ in range(1_300_000))]
    got = count(spark, texts)
    assert [got[i].n_tokens for i in range(2)] == library(texts) and all(got[i].n_bytes > 9_000_000 for i in range(2))


def test_empty_repeats_and_clashing_columns(spark):
    assert tc.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    df = spark.createDataFrame([(None, "a b", 1, "x")] * 3, "doc_id long, text string, row int, n_tokens string")
    assert [r.n_tokens for r in tc.count_tokens(df, PATH).collect()] == [2, 2, 2]
