"""Language identification by unigram piece models that sum over all segmentations of a word.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability under a language
is the sum over all ways to cut it into pieces of the product of their probabilities, found by a forward pass over
its characters; a text's is the product over its words. The probabilities are fitted by expectation maximisation
over the same segmentations, on a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.scratch import materialise
from tessera.llm.texts import held, slices

#: Labelled documents of each language that a model is fitted on, at most: the first by hash of the id.
SAMPLE = 250
#: Characters of a sampled document that a model is fitted on, at most; every document is scored whole.
SAMPLE_CHARS = 20_000
#: Languages that are broadcast and scored at once; more are scored in several passes.
BLOCK_LANGUAGES = 64
#: Rows of sampled ids up to which they are broadcast to find the texts.
MOST_BROADCAST = 50_000
ROUNDS = 2
PSEUDO = 0.05
#: Probability of a character that is no piece, in any language.
UNSEEN = 1e-7
#: Forward and backward values are rescaled each time so many characters are passed, which keeps them in range.
RESCALE = 32
MOST_WORDS = 300_000
#: Scores that a worker keeps, and forward values that it computes at once, at most (of one word at least).
MOST_SCORES = 10_000_000
MOST_CELLS = 2_700_000
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def in_batches(words: list[str], columns: int = 1) -> Iterator[list[str]]:
    """The words by length, so many at a time as have MOST_CELLS forward values in all."""
    words = sorted(words, key=lambda w: (len(w), w))
    begin = 0
    for i in range(1, len(words) + 1):
        if i == len(words) or (i + 1 - begin) * (len(words[i]) + 1) * columns > MOST_CELLS:
            yield words[begin:i]
            begin = i


def window_of(place: np.ndarray | int) -> np.ndarray | int:
    """Positions whose values share a scale: 0 to RESCALE, then RESCALE at a time."""
    return np.maximum(place - 1, 0) // RESCALE


def vocabulary(path: str) -> list[str]:
    """The pieces of letters, in lower case, of the SentencePiece file at ``path``; ``▁`` marks the start of a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = dict.fromkeys(model.id_to_piece(i) for i in range(model.get_piece_size()))
    return [p for p in pieces if p == START or (p.lstrip(START).isalpha() and p == p.lower() and START not in p[1:])]


class Lattice:
    """Where pieces can stand in words, and sums over the paths through them."""

    def __init__(self, pieces: list[str]):
        self.index = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        self.unknown = len(pieces)

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, from, to, piece) of every place of a piece; a character that is no piece is the unknown piece."""
        get, longest, unknown = self.index.get, self.longest, self.unknown
        # Flat numbers, as a tuple for each place would take several times their memory.
        out = array("i")
        for w, word in enumerate(words):
            n = len(word)
            for i in range(n):
                p = get(word[i])
                out.extend((w, i, i + 1, unknown if p is None else p))
                for j in range(i + 2, min(n, i + longest) + 1):
                    p = get(word[i:j])
                    if p is not None:
                        out.extend((w, i, j, p))
        table = np.frombuffer(out, np.int32).reshape(-1, 4)
        return tuple(table[np.argsort(table[:, 2], kind="stable")].T)

    def forward(self, words: list[str], edges, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of all ways to reach each position of each word, and the logs of their scales by window of positions.

        p has a row for each piece and a column for each language.
        """
        word, begin, end, piece = edges
        reach = np.zeros((len(words), max(map(len, words)) + 1, p.shape[1]))
        scale = np.zeros((len(words), window_of(reach.shape[1] - 1) + 1, p.shape[1]))
        reach[:, 0] = 1
        bounds = np.searchsorted(end, np.arange(reach.shape[1] + 1))
        for e in range(1, reach.shape[1]):
            part = slice(bounds[e], bounds[e + 1])
            now = window_of(e)
            if now and (e - 1) % RESCALE == 0:
                last = reach[:, e - 1]
                scale[:, now] = scale[:, now - 1] + np.log(np.where(last > 0, last, 1))
            ways = reach[word[part], begin[part]] * p[piece[part]]
            if now:
                ways *= np.exp(scale[word[part], window_of(begin[part])] - scale[word[part], now])
            for lang in range(p.shape[1]):
                reach[:, e, lang] = np.bincount(word[part], ways[:, lang], len(words))
        return reach, scale

    def score(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log-probability of each word under each language."""
        at, lengths = np.arange(len(words)), np.array([len(w) for w in words])
        edges = self.edges(words)
        # A word that is too long for all languages at once takes fewer of them at a time.
        step = max(1, min(p.shape[1], MOST_CELLS // (len(words) * (int(lengths.max()) + 1))))
        out = []
        for lo in range(0, p.shape[1], step):
            reach, scale = self.forward(words, edges, p[:, lo : lo + step])
            out.append(np.log(reach[at, lengths]) + scale[at, window_of(lengths)])
        return np.concatenate(out, axis=1)

    def expected(self, words: list[str], edges, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, each taken n times, under the probabilities p."""
        word, begin, end, piece = edges
        lengths = np.array([len(w) for w in words])
        ahead, up = (x[:, :, 0] for x in self.forward(words, edges, p[:, None]))
        back, down = np.zeros_like(ahead), np.zeros_like(up)
        at = np.arange(len(words))
        back[at, lengths] = 1
        order = np.argsort(begin, kind="stable")
        bounds = np.searchsorted(begin[order], np.arange(ahead.shape[1] + 1))
        for b in range(ahead.shape[1] - 1, -1, -1):
            part = order[bounds[b] : bounds[b + 1]]
            now = window_of(b)
            if b and b % RESCALE == 0 and now + 1 < up.shape[1]:
                last = back[:, b + 1]
                down[:, now] = down[:, now + 1] + np.log(np.where(last > 0, last, 1))
            ways = back[word[part], end[part]] * p[piece[part]]
            if up.shape[1] > 1:
                ways *= np.exp(down[word[part], window_of(end[part])] - down[word[part], now])
            back[:, b] += np.bincount(word[part], ways, len(words))
        share = ahead[word, begin] * p[piece] * back[word, end] / ahead[word, lengths[word]]
        if up.shape[1] > 1:
            share *= np.exp(up[word, window_of(begin)] + down[word, window_of(end)] - up[word, window_of(lengths[word])])
        return np.bincount(piece, n[word] * share, len(p))


def fit(texts: list[str], pieces: list[str]) -> np.ndarray:
    """Probabilities of the pieces, the unknown piece last, by expectation maximisation over all segmentations."""
    lattice = Lattice(pieces)
    counted = Counter(START + w for t in texts for w in words_of(t))
    p = np.full(len(pieces) + 1, 1.0)
    p[-1] = UNSEEN
    if not counted:
        p[:-1] /= len(pieces)
        return p
    parts = [(words, lattice.edges(words), np.array([counted[w] for w in words], float)) for words in in_batches(list(counted))]
    expected = sum(np.bincount(piece, n[word], len(p)) for _, (word, _, _, piece), n in parts)
    for _ in range(ROUNDS):
        p[:-1] = (expected[:-1] + PSEUDO) / (expected[:-1].sum() + PSEUDO * len(pieces))
        expected = sum(lattice.expected(words, edges, n, p) for words, edges, n in parts)
    p[:-1] = (expected[:-1] + PSEUDO) / (expected[:-1].sum() + PSEUDO * len(pieces))
    return p


def held_out(id_col: Column) -> Column:
    """Documents that no model learns from: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_languages(docs: DataFrame, pieces: list[str], sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(lang, p): piece probabilities of every language, from at most ``sample`` labelled documents of each that are not held out, and ``sample_chars`` of each."""
    spark = docs.sparkSession
    labelled = docs.select("doc_id", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.withColumn("nth", F.row_number().over(by_hash)).filter(F.col("nth") <= sample).select("doc_id", "lang").distinct()
    chosen = materialise(chosen, "language-sample")
    if chosen.count() <= MOST_BROADCAST:
        chosen = F.broadcast(chosen)
    # Repeated ids are cut to the sample again.
    texts = docs.select("doc_id", "lang", "text").filter(F.col("text").isNotNull()).join(chosen, ["doc_id", "lang"])
    texts = texts.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).filter(F.col("nth") <= sample)
    grouped = texts.groupBy("lang").agg(F.sort_array(F.collect_list(F.substring("text", 1, sample_chars))).alias("texts"))
    shared = spark.sparkContext.broadcast(pieces)

    def fit_each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, t in zip(frame["lang"], frame["texts"], strict=True):
                yield pd.DataFrame({"lang": [lang], "p": [fit(list(t), shared.value)]})

    return materialise(grouped.mapInPandas(fit_each, "lang string, p array<double>"), "language-models")


class Scorer:
    """Scores texts with fitted models; keeps the scores of words that it has met."""

    def __init__(self, languages: list[str], p: np.ndarray, pieces: list[str]):
        self.languages, self.p, self.lattice = languages, p, Lattice(pieces)
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)))

    def learn(self, words: list[str]) -> None:
        new = [np.zeros((0, len(self.languages)))]
        for batch in in_batches([START + w for w in words], len(self.languages)):
            new.append(self.lattice.score(batch, self.p))
            self.rows.update(zip([w[1:] for w in batch], range(len(self.rows), len(self.rows) + len(batch)), strict=True))
        self.scores = np.concatenate([self.scores, *new])

    def predict(self, texts: list[str]) -> list[tuple[str | None, float, float]]:
        """Of each text the most probable language, its mean log-probability of a word, and the sum of all over its own.

        Languages are compared by the probability of a word on average, which ranks them as the product over all words
        does; the product itself would tell any long text for certain.

        The language of a text without words is null.
        """
        split = [words_of(t) for t in texts]
        if len(self.rows) > min(MOST_WORDS, MOST_SCORES // len(self.languages)):
            self.rows, self.scores = {}, self.scores[:0]
        self.learn(list({w for words in split for w in words} - self.rows.keys()))
        out: list[tuple[str | None, float, float]] = []
        for words in split:
            if not words:
                out.append((None, 0.0, 1.0))
                continue
            total = self.scores[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))].mean(axis=0)
            best = int(total.argmax())
            out.append((self.languages[best], float(total[best]), float(np.exp(total - total[best]).sum())))
        return out


def scorer_of(key: str, shared) -> Scorer:
    """The scorer of one call of :func:`identify`, kept by a worker for all its tasks."""
    return held(f"scorer {key}", lambda: Scorer(*shared.value))


def identify(docs: DataFrame, path: str, sample: int = SAMPLE, keep: bool = False, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """The language of every whole text of ``docs`` (doc_id, text, lang), learned from its own labelled rows.

    Returns one row (doc_id, held_out, lang_pred, score) for each row: the most probable of the learned languages
    and its posterior under equal priors for a word of the text on average. A text that is null or has no letter is ``und`` with score 0, as is any
    text if nothing is labelled. ``lang`` and ``doc_id`` only choose the rows to learn from. Ties go to the first
    language by name. Null and repeated ids are rows like any other; other columns are ignored. With ``keep`` the
    rows are those of ``docs`` with lang_pred and score added.
    """
    pieces = vocabulary(path)
    models = fit_languages(docs, pieces, sample, sample_chars)
    spark = docs.sparkSession
    languages = [r.lang for r in models.select("lang").orderBy("lang").collect()]
    blocks = [languages[i : i + BLOCK_LANGUAGES] for i in range(0, len(languages), BLOCK_LANGUAGES)]
    chosen = docs if keep else docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    names = [c for c in chosen.columns if keep or c != "text"]
    if not blocks:
        return chosen.select(*names, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))

    def scored(rows: DataFrame, names: list[str], block: list[str]) -> DataFrame:
        """The columns ``names`` of the rows, with the best language of the block: lang_pred, its log-probability, all over its own."""
        found = {r.lang: r.p for r in models.filter(F.col("lang").between(block[0], block[-1])).collect()}
        shared = spark.sparkContext.broadcast((block, np.stack([np.array(found[lang]) for lang in block], axis=1), pieces))
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = scorer_of(key, shared)
            for part, texts in slices(batches):
                told = list(zip(*scorer.predict(texts), strict=True))
                more = [pa.array(list(v), t) for v, t in zip(told, (pa.string(), pa.float64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in names] + more, [*names, "lang_pred", "top", "over"])

        schema = T.StructType([rows.schema[c] for c in names]).add("lang_pred", "string").add("top", "double").add("over", "double")
        return rows.mapInArrow(run, schema)

    if len(blocks) == 1:
        score = F.when(F.col("lang_pred").isNull(), 0.0).otherwise(1 / F.col("over")).alias("score")
        return scored(chosen, names, blocks[0]).select(*names, F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"), score)

    # More languages than a block: a pass for each over numbered rows; what it tells of a row is joined by the number.
    row = f"row_{uuid.uuid4().hex}"
    numbered = materialise(chosen.withColumn(row, F.monotonically_increasing_id()), "language-rows")
    told = [materialise(scored(numbered.select(row, "text"), [row], block).filter("lang_pred is not null"), "language-block") for block in blocks]
    each = reduce(DataFrame.unionByName, told).groupBy(row).agg(
        F.min(F.struct((-F.col("top")).alias("less"), "lang_pred")).alias("best"), F.collect_list(F.struct("top", "over")).alias("all"),
    )
    total = F.aggregate("all", F.lit(0.0), lambda s, x: s + x["over"] * F.exp(x["top"] + F.col("best.less")))
    each = each.select(row, F.col("best.lang_pred").alias("lang_pred"), (1 / total).alias("score"))
    return numbered.join(each, row, "left").select(*names, F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"))


def brute_force(word: str, p: dict[str, float]) -> float:
    """The sum over all segmentations, by recursion; for tests."""
    if not word:
        return 1.0
    total = 0.0
    for i in range(1, len(word) + 1):
        if (q := p.get(word[:i])) or i == 1:
            total += (q or UNSEEN) * brute_force(word[i:], p)
    return total
