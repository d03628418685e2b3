import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken

from tessera.llm import byte_bpe as bb

PATH = P.path("byte_bpe_50k.tiktoken")
TRICKY = [
    None, "", " ", "  ", "\n", " \n ", "a  b\n\n c \t d  ", "Hello, World! it's we've I'll don't 's 't  're", "<|endoftext|>", "é ́ á", "日本語 テスト 12345 ½²",
    "　x y\xa0z\x85w  ", "😀😀 👩‍👩‍👧", "a" * 3000, "!?" * 500 + " ", "x\x1cy \x1f z", " '", "  's x", "\r\n\r\n", "tab\tsep\t\tx",
]


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed=3):
    rng = random.Random(seed)
    pool = list("abcdefgstrevmld'' \n\t.,!ÉéÜß0123456789ΣσäЖж中́\xa0 ") + ["'s", "'re", " the ", "tion", "ing", "  ", "\n\n"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def test_ids_and_round_trip(spark):
    texts = TRICKY + random_texts(500)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bb.encode_documents(df, PATH, P.PATTERN, keep_ids=True).collect()}
    enc = library()
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i].ids == ids, (i, t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_long_words():
    """Words of any length go through the recursive query in parts, also where borders of parts fall into tokens."""
    rng = random.Random(4)
    bpe, enc = bb.ByteBpe(PATH, P.PATTERN), library()
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    long = ["a" * 100_000, "ab" * 30_000, "".join(rng.choice(letters) for _ in range(100_000)), "".join(rng.choice("0123456789") for _ in range(40_000)), "=-" * 900 + "=" * 700, "internationalization" * 300]
    long += ["".join(rng.choice("aeinrst") for _ in range(rng.randint(65, 900))) for _ in range(300)] + ["日本" * 200, "é" * 301]
    for text, (ids, raw) in zip(long, bb.encode_texts(bpe, long), strict=True):
        assert ids == " ".join(map(str, enc.encode_ordinary(text))) and raw == text.encode()


def test_decoded_bytes_are_those_of_the_ids(monkeypatch):
    bpe = bb.ByteBpe(PATH, P.PATTERN)
    bpe.db.execute("UPDATE vocab SET hex = '2a' WHERE name = '64'")
    ((ids, raw),) = bb.encode_texts(bpe, ["a b"])
    assert ids == "64 275" and raw == b"* b"


def test_caches_that_start_anew(monkeypatch):
    monkeypatch.setattr(bb, "KNOWN_BYTES", 1500)
    bpe, enc = bb.ByteBpe(PATH, P.PATTERN), library()
    for t in random_texts(40, seed=8):
        assert bb.encode_texts(bpe, [t])[0][0] == " ".join(map(str, enc.encode_ordinary(t)))


def test_empty_repeats_and_clashing_columns(spark):
    assert bb.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0
    df = spark.createDataFrame([(None, "a b", 1, "x")] * 3, "doc_id long, text string, ids int, n_tokens string")
    assert [r.n_tokens for r in bb.encode_documents(df, PATH, P.PATTERN).collect()] == [2, 2, 2]
