import math
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import language as lg

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "bab"]
    p = np.array([[0.1], [0.2], [0.15], [0.25], [0.1], [0.12], [0.08], [lg.UNSEEN]])
    words = ["▁abab", "▁", "▁bax", "▁aaaa"]
    table = {q: p[i, 0] for i, q in enumerate(pieces)}
    for w, s in zip(words, lg.Lattice(pieces).score(words, p), strict=True):
        assert s[0] == pytest.approx(math.log(lg.brute_force(w, table)))


def test_long_words_are_summed_over_all_segmentations():
    rng = np.random.default_rng(3)
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "bab"]
    p = np.append(rng.random(len(pieces)) / 10, lg.UNSEEN)
    words = ["▁" + "".join(rng.choice(list("abx"), n)) for n in (31, 32, 33, 64, 65, 150, 3000)]
    want = []
    for w in words:
        ways = [0.0]
        for e in range(1, len(w) + 1):
            ways.append(np.logaddexp.reduce([ways[b] + math.log(p[pieces.index(w[b:e])] if w[b:e] in pieces else p[-1]) for b in range(max(0, e - 3), e) if w[b:e] in pieces or e - b == 1]))
        want.append(ways[-1])
    assert lg.Lattice(pieces).score(words, p[:, None])[:, 0] == pytest.approx(want)
    # The derivative of the log-probability by the log of a piece's probability is how often it is expected.
    lattice = lg.Lattice(pieces)
    got = lattice.expected(words, lattice.edges(words), np.ones(len(words)), p)
    for i in range(len(p)):
        up, down = p.copy(), p.copy()
        up[i], down[i] = p[i] * math.exp(1e-4), p[i] * math.exp(-1e-4)
        change = (lattice.score(words, up[:, None]) - lattice.score(words, down[:, None])).sum() / 2e-4
        assert got[i] == pytest.approx(change, rel=1e-4, abs=1e-5)


def test_every_label_is_learned_in_blocks(spark, monkeypatch):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(1000 * i + j, f"{a}{b}{a}{b}{b} {b}{a}{a}{b}{a} " * 3, f"{a}{b}") for i, (a, b) in enumerate((a, b) for a in letters[:15] for b in letters[10:25] if a < b) for j in range(6)]
    docs = spark.createDataFrame([*rows, (None, None, None), (7, "12", "ab")], "doc_id long, text string, lang string")
    assert docs.select("lang").distinct().count() > 130
    many = sorted(map(str, ((r.doc_id, r.lang_pred, round(r.score, 9)) for r in lg.identify(docs, PATH).collect())))
    monkeypatch.setattr(lg, "BLOCK_LANGUAGES", 1000)
    one = sorted(map(str, ((r.doc_id, r.lang_pred, round(r.score, 9)) for r in lg.identify(docs, PATH).collect())))
    assert many == one
    assert len({r.lang_pred for r in lg.identify(docs, PATH, keep=True).collect()} - {"und"}) > 130


def test_fit_is_a_distribution():
    pieces = lg.vocabulary(PATH)
    p = lg.fit(["the thing and the other thing"], pieces)
    assert p[:-1].sum() == pytest.approx(1) and (p > 0).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r for r in lg.identify(docs, PATH).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert out.keys() == truth.keys()
    held = [i for i in out if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i].held_out == (i in set(held)) for i in out)
    assert sum(out[i].lang_pred == truth[i] for i in held) / len(held) > 0.97


def test_edge_cases(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(i, "the cat and the dog of the house", "en", "x") for i in range(20)] + [(100 + i, "der hund und die katze für das haus", "de", "y") for i in range(20)]
    odd = [(900, None, "en", ""), (901, "", "en", ""), (902, "123 !? _", "de", ""), (None, "the house", None, ""), (903, "x" * 5000, None, ""), (903, "und die", "en", "")]
    out = lg.identify(spark.createDataFrame(rows + odd, schema), PATH).collect()
    assert len(out) == len(rows + odd)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.score <= 1
    assert {by[i][0].lang_pred for i in (900, 901, 902)} == {"und"}
    assert by[None][0].lang_pred == "en" and len(by[903]) == 2
    assert lg.identify(spark.createDataFrame([], schema), PATH).count() == 0
    assert lg.identify(spark.createDataFrame([(1, "a b", None, "")], schema), PATH).first().lang_pred == "und"


def test_memory_of_edges():
    """Places of pieces are flat numbers: under 100 bytes each, at the most."""
    lattice = lg.Lattice(["▁", "a", "b", "ab", "ba", "▁a", "aba"])
    words = ["▁" + "".join(random.Random(i).choices("ab", k=20)) for i in range(3000)]
    tracemalloc.start()
    edges = lattice.edges(words)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 100 * len(edges[0])
