"""Searches for many texts at once: an automaton for literal patterns; for similar texts distances in bits, and an index of q-grams."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of patterns or queries that are sent to every task together; more of them take several passes.
PASS_CHARS = 8_000_000
#: Characters of texts that a task works on together, and matches of q-grams, or places for pairs, that it holds at once.
SLICE_CHARS, MOST_MATCHES, MOST_CELLS = 1_000_000, 4_000_000, 16_000_000
#: Characters of lines and blocks that are measured together; line ends of other systems, and white space as of Java's ``\\s``.
STRETCH_CHARS, RETURNS, SPACE = 4_000_000, re.compile("\r\n?"), " \t\n\x0b\f\r"
#: Lines of one band differ in length by at most this factor.
BAND = 1.25
#: Bits of a character in a q-gram, pairs that a task hands on at once, and the threshold below which q-grams tell nothing.
CHAR_BITS, MOST_PAIRS, LEAST_THRESHOLD = 21, 50_000, 0.55
#: More queries than this are looked up by q-grams, from this threshold on; else all pairs of fitting length and letters are measured.
MANY_QUERIES, GRAM_THRESHOLD = 2000, 0.75
#: Classes of characters that are counted, pairs that are measured together and pairs that wait for it.
CLASSES, TOGETHER, WAITING = 64, 1 << 14, 1 << 18
#: Columns after which it is looked again which pairs are still within reach.
LOOK_EVERY = 32


def passes_over(asked: DataFrame, text: str, most: int = PASS_CHARS) -> list[DataFrame]:
    """``asked`` in parts of about ``most`` characters of ``text`` each, by hash; one part if it has no more."""
    chars = asked.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    n = 1 + chars // most
    return [asked] if n == 1 else [asked.filter(F.pmod(F.xxhash64(*asked.columns), F.lit(n)) == i) for i in range(n)]


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches, with their texts, of about SLICE_CHARS characters."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
        begin = chars = 0
        for i, text in enumerate(texts):
            chars += len(text or "")
            if chars >= SLICE_CHARS or i == len(texts) - 1:
                yield batch.slice(begin, i + 1 - begin), [t or "" for t in texts[begin : i + 1]]
                begin, chars = i + 1, 0


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + more


def find_patterns(texts: DataFrame, patterns: DataFrame, text: str = "text", pattern: str = "pattern") -> DataFrame:
    """Each row of ``texts`` with each row of ``patterns`` whose ``pattern`` it holds, and ``at``, where it first stands (from 1).

    An automaton over all patterns is built once in a task and reads each text once, however many patterns there are.
    Patterns are sent to tasks at most PASS_CHARS characters at a time. Null and empty patterns are nowhere, equal
    patterns are each found; null texts hold nothing.
    """
    found = None
    for part in passes_over(patterns.filter(F.length(pattern) > 0), pattern):
        listed = [r[0] for r in part.select(pattern).distinct().collect()]
        places = _places(texts, listed, text)
        met = places.join(part.withColumnRenamed(pattern, "pattern_"), "pattern_").withColumnRenamed("pattern_", pattern)
        found = met if found is None else found.unionByName(met)
    return found


def _places(texts: DataFrame, listed: list[str], text: str) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for p in sent.value:
            machine.add_word(p, p)
        machine.make_automaton()
        for part, values in _slices(batches, text):
            rows, which, at = [], [], []
            for i, value in enumerate(values):
                first: dict[str, int] = {}
                for end, p in machine.iter(value) if len(machine) else ():
                    first.setdefault(p, end - len(p) + 2)
                rows += [i] * len(first)
                which += first
                at += first.values()
            columns = part.take(pa.array(rows, pa.int64())).columns
            yield pa.RecordBatch.from_arrays([*columns, pa.array(which, pa.string()), pa.array(at, pa.int32())], [*part.schema.names, "pattern_", "at"])

    return texts.mapInArrow(run, _schema(texts, ", pattern_ string, at int"))


class GramIndex:
    """Which of some texts (queries) can be more similar to a line than a threshold: by length and by shared q-grams.

    If d edits turn one text into the other, and the longer has n characters, at least n - q + 1 - q d of its q-grams
    stand in the other as well, each moved by at most d places. A similarity over the threshold leaves d < (1 - threshold) n
    edits. Of a query's q-grams all but that many, less one, are its prefix, rarest first: a line without any of them
    shares too few. Pairs of short texts, for which the number is 0, and all pairs at low thresholds are told by length.
    """

    def __init__(self, queries: Sequence[str], threshold: float) -> None:
        self.share = 1 - threshold
        self.q = 3 if threshold >= 0.75 else 2
        self.sizes = np.array([len(t) for t in queries], np.int64)
        #: Longer pairs share q-grams; none do where the threshold is low.
        self.bare = np.iinfo(np.int64).max
        if threshold >= LEAST_THRESHOLD:
            enough = int(self.q / (1 - self.q * self.share)) + 2
            self.bare = int(np.flatnonzero(self.need(np.arange(enough)) <= 0).max(initial=-1))
            self._compile(queries, threshold)
        #: Queries that are told by length alone, in order of it.
        self.short = np.flatnonzero(self.sizes <= self.bare)
        self.short = self.short[np.argsort(self.sizes[self.short], kind="stable")]

    def _compile(self, queries: Sequence[str], threshold: float) -> None:
        """The q-grams of the queries as two tables of places, prefixes and the rest."""
        grams, owner, place = self._grams(queries)
        codes, number, often = np.unique(grams, return_inverse=True, return_counts=True)
        self.codes = np.append(codes, -1)
        # The fewest q-grams that any line of a length that fits has to share.
        longest = int(self.sizes.max(initial=0) / max(threshold, 0.01)) + 2
        need = self.need(np.arange(longest + 1))
        least = np.minimum.accumulate(need[::-1])[::-1][self.sizes]
        order = np.lexsort((number, often[number], owner))
        nth = np.empty(len(order), np.int64)
        nth[order] = np.arange(len(order)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        prefix = nth < (self.counts - least + 1)[owner]
        self.parts = [self._postings(number[m], owner[m], place[m]) for m in (prefix, ~prefix)]

    def edits(self, longer: np.ndarray) -> np.ndarray:
        return np.floor(self.share * longer + 1e-9).astype(np.int64)

    def need(self, longer: np.ndarray) -> np.ndarray:
        """q-grams that two texts have to share, at least."""
        return longer - self.q + 1 - self.q * self.edits(longer)

    def _grams(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all q-grams, the number of their text and their place in it."""
        sizes = np.array([len(t) for t in texts], np.int64)
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        code = np.zeros(max(len(chars) - self.q + 1, 0), np.int64)
        for k in range(self.q):
            code = code << CHAR_BITS | chars[k : k + len(code)]
        whole = place[: len(code)] <= sizes[owner[: len(code)]] - self.q
        self.counts = np.maximum(sizes - self.q + 1, 0)
        return code[whole], owner[: len(code)][whole], place[: len(code)][whole]

    def _postings(self, number: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((place, owner, number))
        starts = np.searchsorted(number[order], np.arange(len(self.codes)))
        return starts, owner[order], place[order]

    def _matches(self, part: int, gram: np.ndarray, line: np.ndarray, place: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """q-grams of lines that stand in queries of fitting length at fitting places: line * queries + query, and both places."""
        starts, owner, at = self.parts[part]
        often = starts[gram + 1] - starts[gram]
        source = np.repeat(np.arange(len(gram)), often)
        entry = np.arange(len(source)) - np.repeat(np.cumsum(often) - often - starts[gram], often)
        query = owner[entry]
        of_line = line[source]
        size, asked = lengths[of_line], self.sizes[query]
        # What moves a q-gram stands before it, and what moves the end of the text behind it: edits do one or the other.
        moved = place[source] - at[entry]
        near = np.abs(moved) + np.abs(size - asked - moved) <= self.edits(np.maximum(size, asked))
        source, entry = source[near], entry[near]
        return of_line[near] * len(self.sizes) + query[near], place[source], at[entry]

    def _too_far(self, pair: np.ndarray, place: np.ndarray, sizes: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Pairs of which one text has too many q-grams that the other lacks: an edit is at fault for q in a row at most.

        ``pair`` and ``place`` say which q-grams of the text, of ``sizes`` characters, the other one has.
        """
        counts = sizes - self.q + 1
        has = np.arange(max(int(counts.max(initial=0)), 1))[:, None] >= counts
        has[place, pair] = True
        edits, free = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for i, present in enumerate(has):
            lacks = ~present & (free <= i)
            edits += lacks
            free[lacks] = i + self.q
        return edits > most

    def candidates(self, lines: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of lines and queries that have to be compared, each pair once, MOST_PAIRS or somewhat more at a time."""
        lengths = np.array([len(t) for t in lines], np.int64)
        if self.bare < 2**62:
            yield from self._by_grams(lines, lengths)
        # A pair is in one of the two: this is for pairs whose longer text is short, or for all.
        sizes = self.sizes[self.short]
        some = np.flatnonzero(lengths <= self.bare)
        first = np.searchsorted(sizes, np.floor(lengths[some] * (1 - self.share)) - 1)
        last = np.searchsorted(sizes, np.minimum(np.ceil(lengths[some] / max(1 - self.share, 1e-9)), 2**62) + 1, "right")
        upto = np.cumsum(last - first)
        lo = 0
        while lo < len(some):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + MOST_PAIRS, "right")))
            often = (last - first)[lo:hi]
            line = np.repeat(some[lo:hi], often)
            query = self.short[np.arange(len(line)) - np.repeat(np.cumsum(often) - often - first[lo:hi], often)]
            longer = np.maximum(lengths[line], self.sizes[query])
            fits = (np.abs(lengths[line] - self.sizes[query]) <= self.edits(longer)) & ((self.need(longer) <= 0) | (self.bare > 2**62))
            yield line[fits], query[fits]
            lo = hi

    def _by_grams(self, lines: list[str], lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = len(self.sizes)
        gram, line, place = self._grams(lines)
        at = np.searchsorted(self.codes[:-1], gram)
        known = self.codes[at] == gram
        gram, line, place = at[known], line[known], place[known]
        edges = np.searchsorted(line, np.arange(len(lines) + 1))
        total = np.concatenate([[0], np.cumsum(sum(s[gram + 1] - s[gram] for s, _, _ in self.parts))])[edges]
        lo = 0
        while lo < len(lines):
            hi = max(lo + 1, min(lo + max(1, MOST_MATCHES // n), int(np.searchsorted(total, total[lo] + MOST_MATCHES, "right")) - 1))
            mine, size = slice(edges[lo], edges[hi]), lengths[lo:hi]
            first = self._matches(0, gram[mine], line[mine] - lo, place[mine], size)
            some = np.zeros(hi - lo, bool)
            some[first[0] // n] = True
            rest = some[line[mine] - lo]
            more = self._matches(1, gram[mine][rest], line[mine][rest] - lo, place[mine][rest], size)
            key, at_line, at_query = (np.concatenate(x) for x in zip(first, more, strict=True))
            in_prefix = np.bincount(first[0], minlength=(hi - lo) * n) > 0
            # q-grams of the line that the query has: each place once, however often the query has its q-gram.
            again = np.append(False, (key[1:] == key[:-1]) & (at_line[1:] == at_line[:-1]))[: len(key)]
            shared = np.bincount(key[~again], minlength=(hi - lo) * n)
            pairs = np.flatnonzero(in_prefix)
            need = self.need(np.maximum(size[pairs // n], self.sizes[pairs % n]))
            pairs = pairs[(need > 0) & (shared[pairs] >= need)]
            step = max(1, MOST_CELLS // int(max(size.max(initial=1), self.sizes.max(initial=1))))
            for i in range(0, len(pairs), min(step, MOST_PAIRS)):
                yield tuple(x + y for x, y in zip(self._compared(pairs[i : i + min(step, MOST_PAIRS)], key, at_line, at_query, size), (lo, 0), strict=True))
            lo = hi

    def _compared(self, pairs: np.ndarray, key: np.ndarray, at_line: np.ndarray, at_query: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``pairs`` (line * queries + query) of which neither text has too many q-grams that the other lacks."""
        nth = np.searchsorted(pairs, key)
        mine = pairs[np.minimum(nth, len(pairs) - 1)] == key
        line, query = pairs // len(self.sizes), pairs % len(self.sizes)
        most = self.edits(np.maximum(lengths[line], self.sizes[query]))
        far = self._too_far(nth[mine], at_line[mine], lengths[line], most) | self._too_far(nth[mine], at_query[mine], self.sizes[query], most)
        return line[~far], query[~far]


class BandedIndex:
    """An index of q-grams for each band of lengths of lines, over the queries that fit them; made when first needed."""

    def __init__(self, queries: Sequence[str], threshold: float) -> None:
        self.queries, self.threshold = queries, threshold
        self.sizes = np.array([len(q) for q in queries], np.int64)
        self.bands: dict[int, tuple[np.ndarray, GramIndex]] = {}

    def _band(self, band: int) -> tuple[np.ndarray, GramIndex]:
        if band not in self.bands:
            least, most = BAND**band * self.threshold - 2, BAND ** (band + 1) / max(self.threshold, 1e-9) + 2
            fits = np.flatnonzero((self.sizes >= least) & (self.sizes <= most))
            self.bands[band] = fits, GramIndex([self.queries[i] for i in fits], self.threshold)
        return self.bands[band]

    def candidates(self, lines: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        band = np.floor(np.log(np.maximum([len(t) for t in lines], 1)) / math.log(BAND)).astype(np.int64)
        for b in np.unique(band).tolist():
            mine = np.flatnonzero(band == b)
            fits, index = self._band(b)
            if len(fits):
                for line, query in index.candidates([lines[i] for i in mine]):
                    yield mine[line], fits[query]


def _fitting(rows: DataFrame, queries: list[str], threshold: float, line: str) -> DataFrame:
    """Rows whose ``line`` is neither too short nor too long for all queries."""
    sizes = [len(q) for q in queries] or [0]
    longest = math.ceil(max(sizes) / threshold) + 1 if threshold > 0 else None
    fits = F.length(line) >= math.floor(min(sizes) * threshold)
    return rows.filter(fits if longest is None else fits & (F.length(line) <= longest))


def candidates(rows: DataFrame, queries: list[str], threshold: float, line: str = "line") -> DataFrame:
    """Each row with the number (``query_no``) of each query that its ``line`` may resemble over the threshold."""
    sent = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = BandedIndex(sent.value, threshold)
        for part, values in _slices(batches, line):
            for which, query in index.candidates(values):
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(which)).columns, pa.array(query, pa.int32())], [*part.schema.names, "query_no"])

    rows = _fitting(rows, queries, threshold, line)
    return rows.mapInArrow(run, _schema(rows, ", query_no int"))


def _chars(texts: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class BitQueries:
    """Some texts (queries) as bits, for the edit distances of lines to them: Myers' algorithm, for many pairs at once.

    A column of a pair's matrix is kept as its vertical differences, 64 rows in a word, and follows from the one before by
    a few operations on words, whatever the distance; a pair is given up at a column from which it can't be within reach
    any more. Pairs whose lengths or whose counts of characters alone leave no
    similarity over the threshold are not measured. Where queries and lines are of several kinds, only those of one kind
    meet; pairs of all kinds are measured together.
    """

    def __init__(self, queries: Sequence[str], threshold: float, kinds: Sequence[int] | None = None) -> None:
        self.threshold = threshold
        self.sizes = np.array([len(t) for t in queries], np.int64)
        self.kinds = np.zeros(len(queries), np.int64) if kinds is None else np.array(kinds, np.int64)
        self.chars = _chars(queries)
        self.starts = np.cumsum(self.sizes) - self.sizes
        #: Characters of the queries, in order; all others have the last code.
        self.known = np.unique(self.chars)
        self.words = np.maximum((self.sizes + 63) // 64, 1)
        self.chars = np.searchsorted(self.known, self.chars)
        self.counts = self._count(self.chars, self.sizes)

    def _count(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return np.bincount(owner * CLASSES + codes % CLASSES, minlength=len(sizes) * CLASSES).astype(np.int32).reshape(-1, CLASSES)

    def edits(self, longer: np.ndarray) -> np.ndarray:
        return np.floor((1 - self.threshold) * longer + 1e-9).astype(np.int64)

    def similar(self, lines: list[str], kinds: Sequence[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of lines and queries more similar than the threshold, with the similarity, each pair once."""
        lengths = np.array([len(t) for t in lines], np.int64)
        chars = _chars(lines)
        codes = np.searchsorted(self.known, chars)
        if len(self.known):
            codes[self.known[np.minimum(codes, len(self.known) - 1)] != chars] = len(self.known)
        counts = self._count(codes, lengths)
        begins = np.cumsum(lengths) - lengths
        kinds = np.zeros(len(lines), np.int64) if kinds is None else np.array(kinds, np.int64)
        order = np.lexsort((lengths, kinds))
        in_order = lengths[order]
        counts = counts[order]
        edges = {k: (int(np.searchsorted(kinds[order], k)), int(np.searchsorted(kinds[order], k, "right"))) for k in np.unique(self.kinds).tolist()}
        held, waiting = [], 0
        for query, size in enumerate(self.sizes.tolist()):
            begin, end = edges[int(self.kinds[query])]
            lo = begin + int(np.searchsorted(in_order[begin:end], math.floor(size * self.threshold) - 1))
            hi = end if self.threshold <= 0 else begin + int(np.searchsorted(in_order[begin:end], math.ceil(size / self.threshold) + 1, "right"))
            # Each edit mends one character that the line has too many, one that it has too few, or both.
            apart = np.abs(counts[lo:hi] - self.counts[query]).sum(1) + np.abs(in_order[lo:hi] - size)
            fits = order[lo:hi][apart <= 2 * self.edits(np.maximum(in_order[lo:hi], size))]
            held.append((fits, np.full(len(fits), query)))
            waiting += len(fits)
            if waiting >= WAITING:
                yield from self._measured(held, codes, begins, lengths)
                held, waiting = [], 0
        yield from self._measured(held, codes, begins, lengths)

    def _measured(self, held: list[tuple[np.ndarray, np.ndarray]], codes: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if not held:
            return
        line, query = (np.concatenate(x) for x in zip(*held, strict=True))
        words = self.words[query]
        for n in np.unique(words).tolist():
            mine = np.flatnonzero(words == n)
            # The masks of the queries of a round, and the columns of its pairs, are bounded as well.
            group = query[mine] // max(1, MOST_CELLS // 4 // ((len(self.known) + 1) * n))
            mine = mine[np.lexsort((-lengths[line[mine]], group))]
            group = np.sort(group)
            most = max(1, min(TOGETHER, MOST_CELLS // 4 // n))
            for g in np.unique(group).tolist():
                first, last = np.searchsorted(group, g), np.searchsorted(group, g, "right")
                for i in range(first, last, most):
                    part = mine[i : min(i + most, last)]
                    of_line, of_query = line[part], query[part]
                    size = lengths[of_line]
                    longer = np.maximum(size, self.sizes[of_query])
                    found = np.where(longer == 0, 1.0, (longer - self._distances(codes, begins[of_line], size, of_query, n, longer)) / np.maximum(longer, 1))
                    over = found > self.threshold
                    yield of_line[over], of_query[over], found[over]

    def _masks(self, queries: np.ndarray, words: int) -> np.ndarray:
        """For each word, query and code the rows of the query that have it."""
        sizes = self.sizes[queries]
        nth = np.repeat(np.arange(len(queries)), sizes)
        place = np.arange(len(nth)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        masks = np.zeros((words, len(queries) * (len(self.known) + 1)), np.uint64)
        code = self.chars[np.repeat(self.starts[queries], sizes) + place]
        np.add.at(masks, (place // 64, nth * (len(self.known) + 1) + code), np.uint64(1) << (place % 64).astype(np.uint64))
        return masks

    @staticmethod
    def _least(plus: np.ndarray, minus: np.ndarray, column: int, ahead: np.ndarray) -> np.ndarray:
        """The least distance that pairs can end with, from a column of their matrices; ``ahead`` is by how many rows the
        last cell's diagonal is ahead there. Neighbouring cells differ by one at most, and what is off the diagonal costs."""
        steps = (np.bitwise_count(m.view(np.uint16)).astype(np.int8).reshape(len(m), -1, 4) for m in (plus, minus))
        steps = np.subtract(*steps).transpose(1, 0, 2).reshape(plus.shape[1], -1)
        at = np.full((len(steps), steps.shape[1] + 1), column, np.int32)
        at[:, 1:] += np.cumsum(steps, axis=1, dtype=np.int32)
        row, diagonal = np.arange(0, 16 * steps.shape[1], 16, dtype=np.int32), (column + ahead).astype(np.int32)[:, None]
        off = np.maximum(np.maximum(row - diagonal, diagonal - row - 16), 0)
        return ((at[:, :-1] + at[:, 1:] - 15 >> 1) + off).min(1)

    def _distances(self, codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray, query: np.ndarray, words: int, longer: np.ndarray) -> np.ndarray:
        """Edit distances of pairs in order of falling size of the line; all queries have so many words.

        Of pairs that are given up it is ``longer``, the size of the longer text.
        """
        queries, nth = np.unique(query, return_inverse=True)
        masks, base = self._masks(queries, words), nth * (len(self.known) + 1)
        n, one, top = len(sizes), np.uint64(1), np.uint64(63)
        plus, minus = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
        space = np.empty((7, n), np.uint64)
        kept, most, out = np.arange(n), self.edits(longer), longer.copy()
        for j in range(int(sizes.max(initial=0))):
            # Lines that have a character at a place come first.
            a = len(sizes) - int(np.searchsorted(sizes[::-1], j, "right"))
            if not a:
                break
            if j and j % LOOK_EVERY == 0 and self.threshold > 0 and j > most[:a].min():
                stay = np.ones(len(sizes), bool)
                stay[:a] = self._least(plus[:, :a], minus[:, :a], j, self.sizes[query[:a]] - sizes[:a]) <= most[:a]
                if not stay.all():
                    plus, minus = np.compress(stay, plus, axis=1), np.compress(stay, minus, axis=1)
                    base, begins, sizes, query, kept, most = (v[stay] for v in (base, begins, sizes, query, kept, most))
                    a = int(stay[:a].sum())
                    if not a:
                        break
            at = base[:a] + codes[begins[:a] + j]
            eq, vertical, across, up, down, up_in, down_in = space[:, :a]
            for w in range(words):
                p, m = plus[w, :a], minus[w, :a]
                np.take(masks[w], at, out=eq, mode="clip")
                np.bitwise_or(eq, m, out=vertical)
                if w:
                    eq |= down_in
                np.bitwise_and(eq, p, out=across)
                across += p
                across ^= p
                across |= eq
                np.bitwise_or(across, p, out=up)
                np.invert(up, out=up)
                up |= m
                np.bitwise_and(p, across, out=down)
                # What leaves a word at its last row enters the next one; into the first comes the row before the query.
                np.right_shift(up, top, out=eq)
                np.right_shift(down, top, out=across)
                up <<= one
                up |= up_in if w else one
                down <<= one
                if w:
                    down |= down_in
                np.bitwise_or(vertical, up, out=p)
                np.invert(p, out=p)
                p |= down
                np.bitwise_and(up, vertical, out=m)
                up_in[:], down_in[:] = eq, across
        rows = self.sizes[query] - 64 * (words - 1)
        last = np.where(rows >= 64, ~np.uint64(0), (one << np.minimum(rows, 63).astype(np.uint64)) - one)
        plus[-1] &= last
        minus[-1] &= last
        out[kept] = sizes + np.bitwise_count(plus).sum(0, dtype=np.int64) - np.bitwise_count(minus).sum(0, dtype=np.int64)
        return out


def measured(rows: DataFrame, queries: list[str], threshold: float, line: str = "line") -> DataFrame:
    """Each row with the number (``query_no``) of each query that its ``line`` resembles over the threshold, and the ``similarity``."""
    sent = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = BitQueries(sent.value, threshold)
        for part, values in _slices(batches, line):
            for which, query, found in bits.similar(values):
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(which)).columns, pa.array(query, pa.int32()), pa.array(found)], [*part.schema.names, "query_no", "similarity"])

    rows = _fitting(rows, queries, threshold, line)
    return rows.mapInArrow(run, _schema(rows, ", query_no int, similarity double"))


def _stretches(texts: list[str], ranges: dict[int, tuple[float, float]]) -> Iterator[tuple[list[int], list[int], list[int], list[str], list[str]]]:
    """Lines of the texts and blocks of their lines whose length without white space at the ends is within the range of
    their number of lines: text, number of lines, first line, the stretch and its stripped form, about STRETCH_CHARS at a time."""
    held, chars = [], 0
    for i, text in enumerate(texts):
        lines = RETURNS.sub("\n", text).split("\n")
        # Where each line begins, and the last ends, with one character between two of them.
        begins = np.cumsum([0, *[len(t) + 1 for t in lines]])
        for k, (least, most) in ranges.items():
            if k > len(lines):
                continue
            for first in np.flatnonzero(begins[k:] - begins[:-k] - 1 >= least).tolist():
                stretch = lines[first] if k == 1 else "\n".join(lines[first : first + k])
                bare = stretch.strip(SPACE)
                if least <= len(bare) <= most:
                    held.append((i, k, first + 1, stretch, bare))
                    chars += len(bare)
                    if chars >= STRETCH_CHARS:
                        yield tuple(map(list, zip(*held, strict=True)))
                        held, chars = [], 0
    if held:
        yield tuple(map(list, zip(*held, strict=True)))


def measured_stretches(texts: DataFrame, queries: list[tuple[int, str]], threshold: float, shortest: tuple[int, int], text: str = "text") -> DataFrame:
    """Each row of ``texts`` with each line, or block of lines, of its ``text`` that resembles a query of as many lines over the threshold.

    Queries are (number of lines, text without white space at its ends); lines and blocks are compared without it, from
    ``shortest`` characters on. One pass makes the lines and blocks where the text is, so that no block is moved. Instead
    of the text a row has query_no, similarity, line_no (the first line) and stretch, the line or block as it stands.
    """
    sent = texts.sparkSession.sparkContext.broadcast(queries)
    more = ["query_no", "similarity", "line_no", "stretch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [k for k, _ in sent.value]
        bits = BitQueries([q for _, q in sent.value], threshold, kinds)
        ranges = {}
        for k in sorted(set(kinds)):
            sizes = bits.sizes[bits.kinds == k]
            ranges[k] = max(shortest[k > 1], math.floor(sizes.min() * threshold)), math.ceil(sizes.max() / threshold) + 1 if threshold > 0 else math.inf
        for part, values in _slices(batches, text):
            kept = part.select([c for c in part.schema.names if c != text])
            for row, k, first, stretch, bare in _stretches(values, ranges):
                for which, query, found in bits.similar(bare, k):
                    columns = [*kept.take(pa.array(np.array(row, np.int64)[which])).columns, pa.array(query, pa.int32()), pa.array(found)]
                    columns += [pa.array(np.array(first, np.int32)[which]), pa.array([stretch[i] for i in which], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, [*kept.schema.names, *more])

    schema = _schema(texts.drop(text), ", query_no int, similarity double, line_no int, stretch string")
    return texts.mapInArrow(run, schema)


def similar_stretches(texts: DataFrame, queries: DataFrame, threshold: float, shortest: tuple[int, int], text: str = "text") -> DataFrame:
    """``texts`` and ``queries`` (size, a number of lines, and query) of which a line or block is more similar than the threshold.

    As :func:`measured_stretches`, for any number of queries: they go to every task, PASS_CHARS characters at a time.
    Texts are dealt out over all tasks first. Null texts and queries resemble nothing.
    """
    texts = texts.filter(F.col(text).isNotNull()).repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = None
    for part in passes_over(queries.filter(F.col("query").isNotNull()), "query"):
        listed = sorted((r.size, r["query"]) for r in part.select("size", "query").distinct().collect())
        numbered = part.sparkSession.createDataFrame([(i, *q) for i, q in enumerate(listed)], "query_no int, size int, query string").join(part, ["size", "query"])
        met = measured_stretches(texts, listed, threshold, shortest, text).join(F.broadcast(numbered), "query_no").drop("query_no")
        found = met if found is None else found.unionByName(met)
    return found


def similarity_over(a: Column, b: Column, threshold: float) -> Column:
    """The similarity of two texts where it is over ``threshold``, else null; the distance is given up once it is too large."""
    longer = F.greatest(F.length(a), F.length(b))
    distance = F.call_function("levenshtein", a, b, F.floor(F.lit(1 - threshold) * longer + F.lit(1e-9)).cast("int"))
    found = F.when(longer == 0, 1.0).when(distance >= 0, (longer - distance) / longer)
    return F.when(found > threshold, found)


def similar_pairs(rows: DataFrame, queries: DataFrame, threshold: float, line: str = "line", query: str = "query") -> DataFrame:
    """``rows`` and ``queries`` whose ``line`` and ``query`` are more similar than the threshold, with the similarity.

    Queries go to every task, PASS_CHARS characters of them at a time. Distances cost far more than moving the rows, so
    these are dealt out over all tasks first. Pairs are measured in bits, or, where very many queries are looked for at a
    high threshold, found by q-grams first. No pair over the threshold is lost. Null texts resemble nothing.
    """
    rows = rows.filter(F.col(line).isNotNull())
    spread = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[c for c in rows.columns if c != line][:2] or [line])
    found = None
    for part in passes_over(queries.filter(F.col(query).isNotNull()), query):
        listed = sorted(r[0] for r in part.select(query).distinct().collect())
        numbered = part.sparkSession.createDataFrame(list(enumerate(listed)), f"query_no int, `{query}` string").join(part, query)
        if len(listed) > MANY_QUERIES and threshold >= GRAM_THRESHOLD:
            met = candidates(spread, listed, threshold, line).join(F.broadcast(numbered), "query_no").drop("query_no")
            met = met.withColumn("similarity", similarity_over(F.col(line), F.col(query), threshold)).filter(F.col("similarity").isNotNull())
        else:
            met = measured(spread, listed, threshold, line).join(F.broadcast(numbered), "query_no").drop("query_no")
            met = met.select(*spread.columns, *[c for c in met.columns if c not in (*spread.columns, "similarity")], "similarity")
        found = met if found is None else found.unionByName(met)
    return found
