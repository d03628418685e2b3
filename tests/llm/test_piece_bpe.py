import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from tessera.llm import piece_bpe as pb

PATH = P.path("piece_bpe_32k.model")
TRICKY = [
    None, "", " ", "  ", "   a", "a", "▁a", "▁", "▁▁ ▁", "a\x00b", "\n", "\n\n x\t", "the the thethethe", "日本語テスト 12345 ½²", "😀😀x 👩‍👩‍👧", "<s>", "</s><unk><0x0A>", "�",
    "a" * 3000, "ab" * 2000, " " * 500, "é" * 301, "=-" * 900 + "=" * 700, "internationalization" * 300, "é ́ á \xa0　z",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def bpe():
    return pb.PieceBpe(PATH)


def random_texts(n, seed=3):
    rng = random.Random(seed)
    pool = [*"abcdefgstrevmld'' \n\t.,!ÉéÜß0123456789ΣσäЖж中́\xa0 ▁", "'s", " the ", "tion", "ing", "  ", "the", "▁▁", "in"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 150))) for _ in range(n)]


def test_ids_and_round_trip(spark, library):
    texts = TRICKY + random_texts(800)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in pb.encode_pieces(df, PATH, keep_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].ids == ids, (i, t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_long_words(bpe, library):
    """Words of any length go through the rounds in parts, also where borders of parts fall into tokens."""
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    long = ["a" * 100_000, "".join(rng.choice(letters) for _ in range(100_000)), "日本" * 20_000, "the" * 9000, " " * 70_001]
    long += ["".join(rng.choice("aeinrsth") for _ in range(rng.randint(60, 900))) for _ in range(300)]
    for text, ids in zip(long, bpe.encode(long), strict=True):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_rounds_take_the_leftmost_pairs(bpe):
    """aaaa and aaaaa: pairs of one rank that overlap are taken from the left."""
    for n in range(1, 12):
        symbols, word = bpe.merge(bpe.symbol[np.full(n, ord("a"))], np.zeros(n, np.int64))
        assert bpe._tokens([bpe.symbol[np.full(n, ord("a"))]]) == [symbols.tolist()] and set(word) == {0}
    together = bpe._tokens([bpe._symbols(w) for w in ("▁the", "ing", "x", "thethe")])
    assert together == [bpe._tokens([bpe._symbols(w)])[0] for w in ("▁the", "ing", "x", "thethe")]


def test_decode_of_any_ids(bpe, library):
    """Byte pieces in any order, begin, end and the unknown piece among them."""
    rng = random.Random(5)
    some = [[rng.choice([rng.randint(0, 31_999), rng.randint(0, 300), 29_871]) for _ in range(rng.randint(0, 20))] for _ in range(2000)]
    some += [[rng.randint(131, 258) for _ in range(8)] for _ in range(1000)]
    for ids in some:
        assert bpe.decode(ids) == library.decode(ids), ids


def test_words_kept_are_bounded(bpe, library, monkeypatch):
    monkeypatch.setattr(bpe.known, "most", 3000)
    for t in random_texts(60, seed=8):
        assert bpe.encode([t])[0].tolist() == library.encode(t, add_bos=True, add_eos=True)
        assert bpe.known.size < 3000 + 400 * (len(t) + 2)


def test_empty_repeats_and_clashing_columns(spark):
    assert pb.encode_pieces(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    df = spark.createDataFrame([(None, "a b", 1, "x")] * 3, "doc_id long, text string, ids int, n_tokens string")
    assert [r.n_tokens for r in pb.encode_pieces(df, PATH).collect()] == [4, 4, 4]
