import math
import random

from tessera.llm import licenses as li

SCHEMA = "doc_id long, text string"


def brute(text):
    low = (text or "").translate(str.maketrans(li._UPPER, li._LOWER))
    words = li.words_of(low)
    base, labels, best = [], set(), 0.0
    named = set()
    for phrase, label in li.PHRASES.items():
        p = li.words_of(phrase)
        hits = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        base += hits
        named |= {label} if hits else set()
    for label, texts in li.TEMPLATES.items():
        for t in texts:
            want = set(li.words_of(t))
            need = math.ceil(li.CONTAINMENT * len(want) - 1e-9)
            step = li.step_of(li.words_of(t))
            for i in range(0, len(words), step):
                shared = len(want & set(words[i : i + 2 * step]))
                if shared >= need:
                    labels.add(label)
                    best = max(best, shared / len(want))
    return (len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(named)), ",".join(sorted(named | labels)), 1.0 if base else best)


def texts():
    rng = random.Random(5)
    every = [t for ts in li.TEMPLATES.values() for t in ts]
    noise = "the of and to in a is by under use copy software notice free work any public license mit apache general gnu é ü".split()
    out = [None, "", " \n ", "MIT License", "the mit\nlicense! Apache-License; MIT  License", "mit licensed", "x" * 100, "ümit license", "GENERAL public LICENSE general public license"]
    for _ in range(200):
        parts = []
        for _ in range(rng.randint(1, 8)):
            words = rng.choice(every).split() if rng.random() < 0.4 else [rng.choice(noise) for _ in range(rng.randint(0, 12))]
            kept = [w for w in words if rng.random() < rng.choice([0.75, 0.9, 1.0])]
            parts += kept + [rng.choice(["\n", " ", ". ", "\n\n"])]
        out.append(" ".join(parts))
    return out


def test_against_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in li.scan_licenses(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(got) == len(rows)
    quoted = 0
    for i, t in rows:
        r = got[i]
        want = brute(t)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == want[:6], t
        assert abs(r.score - want[6]) < 1e-12
        quoted += want[4] != want[5]
    assert quoted > 10


def test_quotations_over_many_lines_and_words_that_only_lie_about(spark):
    """A quotation is found however it is wrapped; a long text that holds its words far from each other is not."""
    rng = random.Random(2)
    quote = li.TEMPLATES["gpl"][1].split()
    wrapped = "/*\n" + "".join(f" * {w}\n *\n" for w in quote) + " */"
    scattered = " ".join(w + " " + " ".join(rng.choice(["house", "letter", "green"]) for _ in range(40)) for w in quote)
    long = " ".join(["house"] * 400_000) + " " + " ".join(quote)
    rows = [(1, wrapped), (2, scattered), (3, long), (4, " ".join(li.TEMPLATES["cc"][0].split()[:2] + ["x"] * 30 + li.TEMPLATES["cc"][0].split()[2:]))]
    got = {r.doc_id: r.labels for r in li.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "gpl", 2: "", 3: "gpl", 4: ""}


def test_empty_repeats_and_clashing_columns(spark):
    assert li.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "MIT license", 1, "x")] * 3, SCHEMA + ", row int, labels string")
    assert [r.labels for r in li.scan_licenses(df).collect()] == ["mit"] * 3
