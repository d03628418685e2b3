"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside each partition.

A text is cut into matches of the tokenizer's pattern, and each distinct match is encoded once: one row for each
(word, position) joins the merge table, and a recursive query contracts the leftmost pair of lowest rank of each
word until no word has a pair that merges. Decoding joins the ids with the vocabulary and aggregates the bytes of
each word in order of position. Texts then put together the ids and the decoded bytes that their words gave.

Long words are cut into parts, which the same query encodes. Tokens are what the whole word would give if and only if
each pair of neighbours, taken alone, gives that pair again: up to the first merge across a border, what happens
inside a pair of neighbours is the same in the word and in the pair alone, as each merge is the least by rank and
place, so that merge would happen in the pair as well. Borders where that fails are encoded anew with tokens around
them, ever more, until all hold.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.texts import WHITE_SPACE, Known, file_bytes, held, slices

#: Bytes of encoded runs and words that a worker keeps in each of two generations, so that what it meets often stays.
KNOWN_BYTES = 220_000_000
#: Rows that one recursive query makes, about: a string of n bytes has n in the first step, and one less in each.
QUERY_ROWS = 1_000_000
#: Bytes of the parts that longer words are cut into, and tokens on either side of a border that does not hold.
PART, AROUND = 64, 8
#: Pairs of tokens whose border was looked at that a worker keeps.
MOST_PAIRS = 60_000

# Rows of a word that no longer merges are not carried on; its rows of the last step that it reached are its tokens.
_ENCODE = """
WITH RECURSIVE steps(step, word, pos, tok) AS (
    SELECT 0, word, pos, tok FROM start
    UNION ALL (
        WITH paired AS MATERIALIZED (
            SELECT step, word, pos, tok, lead(pos) OVER w AS next_pos, lead(tok) OVER w AS next_tok
            FROM steps WINDOW w AS (PARTITION BY word ORDER BY pos)
        ), lowest AS (
            SELECT p.word, min((m.rank << 32) | (p.pos << 16) | p.next_pos) AS best
            FROM paired p JOIN merges m ON m.a = p.tok AND m.b = p.next_tok GROUP BY p.word
        )
        SELECT p.step + 1, p.word, p.pos, CASE WHEN p.pos = ((l.best >> 16) & 65535) THEN CAST(l.best >> 32 AS INTEGER) ELSE p.tok END
        FROM paired p JOIN lowest l ON l.word = p.word
        WHERE p.pos <> (l.best & 65535)
    )
)
SELECT s.word, s.pos, s.tok FROM steps s
JOIN (SELECT word, max(step) AS step FROM steps GROUP BY word) l ON l.word = s.word AND l.step = s.step
"""

_DECODE = """
SELECT e.word, string_agg(v.name, ' ' ORDER BY e.pos) AS ids,
       string_agg(v.hex, '' ORDER BY e.pos) AS hex
FROM encoded e JOIN vocab v ON v.tok = e.tok GROUP BY e.word
"""


def _rows(raw: bytes) -> int:
    return len(raw) * (len(raw) + 1) // 2


def _around(places: list[int], n: int, reach: int) -> list[list[int]]:
    """Stretches of tokens around places, joined where they meet."""
    out: list[list[int]] = []
    for p in places:
        lo, hi = max(0, p - reach), min(n, p + reach)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return out


class ByteBpe:
    """The rank file at ``path`` as DuckDB tables, with the runs that this worker has met."""

    def __init__(self, path: str, pattern: str, known: int | None = None, query_rows: int | None = None):
        self.query_rows = query_rows or QUERY_ROWS
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file_bytes(path).splitlines()) }
        self.ranks = ranks
        self.matches = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, rank = (pa.array(x, pa.int32()) for x in zip(*pairs, strict=True))
        self.bytes_of = {r: t for t, r in ranks.items()}
        # Batches are small enough to stay in memory; nothing is spilled to a folder.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        self.db.register("m", pa.table({"a": a, "b": b, "rank": rank}))
        self.db.execute("CREATE TABLE merges AS SELECT a, b, CAST(rank AS BIGINT) AS rank FROM m")
        self.db.register("v", pa.table({"tok": pa.array(ranks.values(), pa.int32()), "name": list(map(str, ranks.values())), "hex": [t.hex() for t in ranks]}))
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM v")
        self.db.unregister("m")
        self.db.unregister("v")
        #: Of each word and run its ids, joined by blanks, a line break, and the bytes that they decode to: one value takes least.
        self.known = Known(known or KNOWN_BYTES)
        self.holds: dict[tuple[int, int], bool] = {}

    def encode_words(self, words: list[str]) -> None:
        """Encode and decode distinct words by recursive and aggregating queries."""
        begin = 0
        raw = [w.encode() for w in words]
        while begin < len(words):
            end, size = begin, 0
            while end < len(words) and (size == 0 or size + min(_rows(raw[end]), PART * len(raw[end])) <= self.query_rows):
                size += min(_rows(raw[end]), PART * len(raw[end]))
                end += 1
            self._encode(words[begin:end], raw[begin:end])
            begin = end

    def _encode(self, words: list[str], raw: list[bytes]) -> None:
        # A word that is itself a token is that token.
        known = [i for i, r in enumerate(raw) if r in self.ranks]
        short = [i for i, r in enumerate(raw) if r not in self.ranks and len(r) <= PART]
        long = [i for i, r in enumerate(raw) if r not in self.ranks and len(r) > PART]
        other = {i: [self.ranks[raw[i]]] for i in known} | dict(zip(long, self._long([raw[i] for i in long]), strict=True))
        self._contract([raw[i] for i in short], np.array(short, np.int32))
        lengths = [len(t) for t in other.values()]
        rows = {"word": np.repeat(np.array(list(other), np.int32), lengths), "pos": np.array([p for n in lengths for p in range(n)], np.int32), "tok": np.array([t for ids in other.values() for t in ids], np.int32)}
        self.db.register("more", pa.table(rows))
        self.db.execute("INSERT INTO encoded SELECT word, pos, tok FROM more")
        self.db.unregister("more")
        found = self.db.sql(_DECODE).to_arrow_table().to_pydict()
        for at, ids, hexed in zip(found["word"], found["ids"], found["hex"], strict=True):
            self._keep(words[at], ids.encode(), bytes.fromhex(hexed))

    def _contract(self, raw: list[bytes], numbers: np.ndarray) -> None:
        """The table ``encoded``: the tokens of each string of bytes under its number."""
        lengths = np.array([len(r) for r in raw], np.int64)
        pos = np.arange(lengths.sum(), dtype=np.int32) - np.repeat(np.cumsum(lengths) - lengths, lengths).astype(np.int32)
        self.db.register("start", pa.table({"word": np.repeat(numbers, lengths), "pos": pos, "tok": self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]}))
        self.db.execute("CREATE OR REPLACE TEMP TABLE encoded AS " + _ENCODE)
        self.db.unregister("start")

    def _tokens(self, raw: list[bytes]) -> list[list[int]]:
        """The tokens of each string of bytes, which are short; equal ones are encoded once."""
        each = dict.fromkeys(raw)
        found: list[list[int]] = []
        every, lo = list(each), 0
        while lo < len(every):
            hi, rows = lo, 0
            while hi < len(every) and (hi == lo or rows + _rows(every[hi]) <= self.query_rows):
                rows += _rows(every[hi])
                hi += 1
            part, lo = every[lo:hi], hi
            self._contract(part, np.arange(len(part), dtype=np.int32))
            rows = self.db.sql("SELECT list(tok ORDER BY pos) AS ids FROM encoded GROUP BY word ORDER BY word").to_arrow_table()
            found += rows.column("ids").to_pylist()
        each = dict(zip(each, found, strict=True))
        return [each[r] for r in raw]

    def _long(self, raw: list[bytes]) -> list[list[int]]:
        """The tokens of long words: parts, whose borders are then made to hold, of all words in the same rounds."""
        parts = [[r[i : i + PART] for i in range(0, len(r), PART)] for r in raw]
        encoded = iter(self._tokens([p for ps in parts for p in ps]))
        words, borders = [], []
        for ps in parts:
            found = [next(encoded) for _ in ps]
            words.append([t for ids in found for t in ids])
            borders.append(np.cumsum([len(ids) for ids in found])[:-1].tolist())
        open_, around = list(range(len(raw))), AROUND
        while open_:
            holds = iter(self._hold([(words[i][p - 1], words[i][p]) for i in open_ for p in borders[i]]))
            bad = {i: [p for p in borders[i] if not next(holds)] for i in open_}
            open_ = [i for i in open_ if bad[i]]
            regions = {i: _around(bad[i], len(words[i]), around) for i in open_}
            new = iter(self._tokens([b"".join(self.bytes_of[t] for t in words[i][lo:hi]) for i in open_ for lo, hi in regions[i]]))
            for i in open_:
                out, edges, place = [], [], 0
                for lo, hi in regions[i]:
                    out += words[i][place:lo]
                    edges.append(len(out))
                    out += next(new)
                    edges.append(len(out))
                    place = hi
                words[i] = out + words[i][place:]
                borders[i] = [p for p in dict.fromkeys(edges) if 0 < p < len(words[i])]
            around *= 2
        return words

    def _hold(self, pairs: list[tuple[int, int]]) -> list[bool]:
        """Whether the bytes of each pair of tokens, taken alone, are encoded as that pair."""
        if len(self.holds) > MOST_PAIRS:
            self.holds.clear()
        new = [p for p in dict.fromkeys(pairs) if p not in self.holds]
        for (a, b), ids in zip(new, self._tokens([self.bytes_of[a] + self.bytes_of[b] for a, b in new]), strict=True):
            self.holds[a, b] = ids == [a, b]
        return [self.holds[p] for p in pairs]

    def _keep(self, key: str, ids: bytes, decoded: bytes) -> None:
        self.known.add(key, ids + b"\n" + decoded, len(ids) + 2 * len(decoded))

    def learn(self, runs: set[str]) -> None:
        """Encode runs of the text; the pattern never matches across the borders of runs, nor differently in a word alone."""
        split = {r: self.matches(r) for r in runs}
        self.encode_words(sorted(self.known.absent({w for words in split.values() for w in words}), key=len))
        for run, words in split.items():
            if len(words) > 1:
                found = [self.known.now[w].split(b"\n", 1) for w in words]
                self._keep(run, b" ".join([i for i, _ in found]), b"".join([d for _, d in found]))


#: What the pattern does at white space: a blank belongs to the word behind it, all before it stands alone.
_RUN = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]")


def codec(path: str, pattern: str, known: int | None = None, query_rows: int | None = None) -> ByteBpe:
    return held(f"codec {path} {pattern}", lambda: ByteBpe(path, pattern, known, query_rows))


def encode_texts(bpe: ByteBpe, texts: list[str]) -> list[tuple[str, bytes]]:
    """(ids joined by blanks, decoded bytes) of each text."""
    split = [_RUN.findall(t) for t in texts]
    if new := bpe.known.missing({r for runs in split for r in runs}):
        bpe.learn(new)
    out = []
    for runs in split:
        found = [v.split(b"\n", 1) for v in map(bpe.known.now.__getitem__, runs)]
        out.append((b" ".join([i for i, _ in found]).decode(), b"".join([d for _, d in found])))
    return out


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, known: int | None = None, query_rows: int | None = None) -> DataFrame:
    """Encode every whole text of ``docs`` with the ranks at ``path`` and decode the ids again.

    Returns one row (id, n_tokens, ids_sha256, decoded_sha256) for each row; with ``keep_ids`` also the ids
    themselves as array<int>. The decoded digest is of the bytes that the ids stand for. Null and empty texts have no
    ids. ``known`` and ``query_rows`` stand for KNOWN_BYTES and QUERY_ROWS where workers have less memory. Very long texts
    and words are encoded whole. Of pairs of equal rank the leftmost merges. Rows are worked on
    where they are, without a shuffle; null and repeated ids are rows like any other, equal texts give equal results;
    other columns are ignored. An empty table gives no rows.
    """
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern, known, query_rows)
        for part, texts in slices(batches):
            rows = encode_texts(bpe, texts)
            columns = [
                part.column(0),
                pa.array([ids.count(" ") + 1 if ids else 0 for ids, _ in rows], pa.int64()),
                pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _ in rows], pa.string()),
                pa.array([hashlib.sha256(raw).hexdigest() for _, raw in rows], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array([np.array(ids.split(), np.int32) if ids else np.array([], np.int32) for ids, _ in rows], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
