"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text, with its blanks written as the vocabulary writes them and one in front, is cut into words at places that no
piece of the vocabulary spans. The symbols of all distinct new words lie in one flat array. A round looks up the rank
of every pair of neighbours, finds the least rank of each word, merges in every word all its leftmost pairs of that
rank that do not overlap, and compacts the array; words without a pair that merges leave it. Rounds go on until no pair
remains. Merging all pairs of a rank at once is what merging them one by one gives if no new pair of the merged symbol
has that rank or a lower one; for symbols of which that does not hold, only the leftmost pair of the word is merged.

Words longer than PART symbols are cut into parts. Tokens are what the whole word gives if and only if each pair of
neighbours, taken alone, gives that pair again: up to the first merge across a border, the merges inside a pair of
neighbours are the same in the word and in the pair alone, as each is the least by rank and place, so that merge would
happen in the pair as well. Tokens around borders that do not hold are encoded anew, ever more of them, until all hold.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tessera.llm.texts import Known, file_bytes, held, slices

#: Symbols of the parts that longer words are cut into, and tokens on either side of a border that does not hold.
PART, AROUND = 64, 8
#: Bytes of the words that a worker keeps with their ids, in each of two generations.
KNOWN_BYTES = 60_000_000
#: Pairs of tokens whose border was looked at that a worker keeps.
MOST_PAIRS = 200_000
BLANK = "▁"
#: What decoding writes for bytes that are no character, and for the unknown piece; fixed values.
NO_CHARACTER, UNKNOWN = "�", " ⁇ "
_CODES = 0x110000


class PieceBpe:
    """The model at ``path``: its pieces as symbols, and the pairs of symbols that merge."""

    def __init__(self, path: str) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(file_bytes(path))
        kinds, norm = sentencepiece_model_pb2.ModelProto.SentencePiece, model.normalizer_spec
        unsupported = [p.piece for p in model.pieces if p.type in (kinds.USER_DEFINED, kinds.UNUSED)]
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or unsupported:
            raise ValueError(f"not a plain BPE model of unchanged text: {path}")
        self.in_front = norm.add_dummy_prefix
        names = [p.piece for p in model.pieces]
        normal = {n: i for i, (n, p) in enumerate(zip(names, model.pieces, strict=True)) if p.type == kinds.NORMAL}
        self.begin, self.end = names.index(model.trainer_spec.bos_piece), names.index(model.trainer_spec.eos_piece)
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.byte_of = {i: int(n[3:5], 16) for i, (n, p) in enumerate(zip(names, model.pieces, strict=True)) if p.type == kinds.BYTE}
        self.ids_of_bytes = {b: i for i, b in self.byte_of.items()}
        #: UTF-8 of each piece; begin and end stand for nothing.
        self.raw = [n.replace(BLANK, " ").encode() if p.type == kinds.NORMAL else b"" for n, p in zip(names, model.pieces, strict=True)]
        for i, b in self.byte_of.items():
            self.raw[i] = bytes([b])
        self.raw[self.unknown] = UNKNOWN.encode()
        #: The symbol of a code point: its piece, or a number beyond all pieces.
        self.size = len(names)
        self.symbol = np.arange(self.size, self.size + _CODES, dtype=np.int64)
        for n, i in normal.items():
            if len(n) == 1:
                self.symbol[ord(n)] = i
        self._compile_pairs(normal, {n: model.pieces[i].score for n, i in normal.items()})
        joined = {c for n in normal if len(n) > 1 for c in n}
        inner = any(re.search(f"[^{BLANK}]{BLANK}", n) for n in normal)
        letters = re.escape("".join(sorted(joined - {BLANK})))
        word = f"[{letters}{BLANK}]+|[^{letters}{BLANK}]" if inner else f"{BLANK}*[{letters}]+|{BLANK}+|[^{letters}{BLANK}]"
        self.words = re.compile(word).findall
        self.known = Known(KNOWN_BYTES)
        self.holds: dict[tuple[int, int], bool] = {}

    def _compile_pairs(self, normal: dict[str, int], scores: dict[str, float]) -> None:
        """Every way to put a piece together from two symbols, as sorted keys with ranks and merged symbols."""
        rank_of = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        symbol = lambda s: normal.get(s, int(self.symbol[ord(s)]) if len(s) == 1 else None)
        found = []
        for name, number in normal.items():
            for cut in range(1, len(name)):
                a, b = symbol(name[:cut]), symbol(name[cut:])
                if a is not None and b is not None:
                    found.append((a * (self.size + _CODES) + b, rank_of[scores[name]], number, a, b))
        keys, ranks, merged, a, b = np.array(sorted(found), np.int64).T if found else np.zeros((5, 0), np.int64)
        self.keys, self.ranks, self.merged = np.append(keys, -1), np.append(ranks, 0), np.append(merged, 0)
        #: Whether a pair with the symbol has its rank or a lower one, so that pairs of its rank merge one by one.
        own = np.full(self.size + _CODES, -1, np.int64)
        own[merged] = ranks
        self.single = np.zeros(self.size, bool)
        for side in (a, b):
            self.single[side[(side < self.size) & (ranks <= own[side])]] = True
        self.none = len(rank_of)

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over flat ``symbols`` of words, numbered in ascending order; the same two arrays when no pair is left."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            key = symbols[:-1] * (self.size + _CODES) + symbols[1:]
            at = np.searchsorted(self.keys[:-1], key)
            merges = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(merges, self.ranks[at], self.none), self.none)
            first = np.append(True, word[1:] != word[:-1])
            starts = np.flatnonzero(first)
            nth = np.cumsum(first) - 1
            least = np.minimum.reduceat(rank, starts)[nth]
            open_ = least < self.none
            if not open_.all():
                done.append((symbols[~open_], word[~open_]))
            # Of pairs of least rank that stand side by side, every second one, from the left.
            place = np.flatnonzero(open_ & (rank == least))
            if not len(place):
                break
            apart = np.append(True, np.diff(place) != 1)
            step = np.arange(len(place))
            place = place[(step - np.maximum.accumulate(np.where(apart, step, 0))) % 2 == 0]
            target = self.merged[at[place]]
            front = np.append(True, nth[place[1:]] != nth[place[:-1]])
            group = np.cumsum(front) - 1
            alone = np.bincount(group, self.single[target])[group] > 0
            taken = front | ~alone
            symbols[place[taken]] = target[taken]
            open_[place[taken] + 1] = False
            symbols, word = symbols[open_], word[open_]
        if not done:
            return symbols, word
        every, numbers = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(numbers, kind="stable")
        return every[order], numbers[order]

    def _tokens(self, parts: list[np.ndarray]) -> list[list[int]]:
        """Merged symbols of each part."""
        if not parts:
            return []
        lengths = [len(p) for p in parts]
        symbols, number = self.merge(np.concatenate(parts), np.repeat(np.arange(len(parts)), lengths))
        return [t.tolist() for t in np.split(symbols, np.searchsorted(number, np.arange(1, len(parts))))]

    def _symbols(self, text: str) -> np.ndarray:
        return self.symbol[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def _spelled(self, tokens: Sequence[int]) -> np.ndarray:
        """The symbols, each of one character, that tokens were merged from."""
        return np.concatenate([self._symbols(self.raw[t].decode().replace(" ", BLANK)) if t < self.size else np.array([t], np.int64) for t in tokens])

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Merged symbols of each word: short ones together in the same rounds, parts of long ones as well."""
        spelled = [self._symbols(w) for w in words]
        parts = [[s[i : i + PART] for i in range(0, len(s), PART)] for s in spelled]
        found = iter(self._tokens([p for ps in parts for p in ps]))
        out, borders = [], {}
        for i, ps in enumerate(parts):
            tokens = [next(found) for _ in ps]
            out.append([t for part in tokens for t in part])
            if len(ps) > 1:
                borders[i] = np.cumsum([len(t) for t in tokens])[:-1].tolist()
        self._join(out, borders)
        return out

    def _join(self, words: list[list[int]], borders: dict[int, list[int]]) -> None:
        """Encode tokens around borders anew, in place, until every border holds."""
        around = AROUND
        while borders:
            holds = iter(self._hold([(words[i][p - 1], words[i][p]) for i, places in borders.items() for p in places]))
            bad = {i: [p for p in places if not next(holds)] for i, places in borders.items()}
            regions = {i: _around(places, len(words[i]), around) for i, places in bad.items() if places}
            new = iter(self._tokens([self._spelled(words[i][lo:hi]) for i, stretches in regions.items() for lo, hi in stretches]))
            borders = {}
            for i, stretches in regions.items():
                joined, edges, place = [], [], 0
                for lo, hi in stretches:
                    joined += words[i][place:lo]
                    edges.append(len(joined))
                    joined += next(new)
                    edges.append(len(joined))
                    place = hi
                words[i] = joined + words[i][place:]
                borders[i] = [p for p in dict.fromkeys(edges) if 0 < p < len(words[i])]
            around *= 2

    def _hold(self, pairs: list[tuple[int, int]]) -> list[bool]:
        """Whether each pair of tokens, taken alone, is encoded as that pair."""
        if len(self.holds) > MOST_PAIRS:
            self.holds.clear()
        new = [p for p in dict.fromkeys(pairs) if p not in self.holds]
        for pair, tokens in zip(new, self._tokens([self._spelled(p) for p in new]), strict=True):
            self.holds[pair] = tokens == list(pair)
        return [self.holds[p] for p in pairs]

    def _ids(self, tokens: list[int]) -> list[int]:
        """Ids of merged symbols: a character that is no piece is its bytes, or the unknown piece where these are none."""
        if all(t < self.size for t in tokens):
            return tokens
        ids: list[int] = []
        for t in tokens:
            raw = [] if t < self.size else [self.ids_of_bytes.get(b, self.unknown) for b in chr(t - self.size).encode()]
            ids += [t] if t < self.size else [self.unknown] if self.unknown in raw else raw
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, begin and end among them."""
        front, begin, end = BLANK * self.in_front, np.uint32(self.begin).tobytes(), np.uint32(self.end).tobytes()
        split = [self.words(front + t.replace(" ", BLANK)) if t else [] for t in texts]
        new = sorted(self.known.missing({w for words in split for w in words}))
        for word, tokens in zip(new, self.encode_words(new), strict=True):
            ids = np.array(self._ids(tokens), "<u4").tobytes()
            self.known.add(word, ids, 2 * len(word) + len(ids))
        return [np.frombuffer(begin + b"".join(map(self.known.now.__getitem__, words)) + end, "<u4") for words in split]

    def decode(self, ids: Sequence[int]) -> str:
        """The text that ids stand for, without the blank in front of its first piece.

        Byte pieces that stand together are read as UTF-8; a byte that is part of no character is U+FFFD.
        """
        raw = b"".join(map(self.raw.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_runs(ids)
        if self.in_front and text.startswith(" "):
            first = next(i for i in ids if self.raw[i])
            return text if first in self.byte_of or first == self.unknown else text[1:]
        return text

    def _decode_runs(self, ids: Sequence[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, self.begin]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
            else:
                out += [_characters(bytes(run)), self.raw[i].decode()]
                run.clear()
        return "".join(out)


def _characters(run: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that is part of no character."""
    out, place = [], 0
    while place < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[place : place + size].decode())
            except UnicodeDecodeError:
                continue
            break
        else:
            out.append(NO_CHARACTER)
            size = 1
        place += size
    return "".join(out)


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


def codec(path: str) -> PieceBpe:
    return held(f"pieces {path}", lambda: PieceBpe(path))


def _mapped(docs: DataFrame, columns: list[str], schema: str, work: Callable[[pa.RecordBatch, list[str]], list[pa.Array]]) -> DataFrame:
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(columns))] + work(part, texts), names)

    return docs.mapInArrow(run, schema)


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every whole text of ``docs`` with the model at ``path``, begin and end ids included, and decode the ids again.

    Returns one row (doc_id, n_tokens, ids_sha256, decoded_sha256) for each row, with ``keep_ids`` also the ids as
    array<int>. ``ids_sha256`` is of the ids as little-endian unsigned 32-bit integers, ``decoded_sha256`` of the UTF-8
    of what the ids stand for. Null and empty texts are the begin and the end id alone. Very long texts and words are
    encoded whole. Of pairs of equal rank the leftmost merges. Rows are worked on where they are, without a shuffle;
    null and repeated ids are rows like any other, equal texts give equal results; other columns are ignored. An empty
    table gives no rows.
    """
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]

    def work(_: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
        bpe = codec(path)
        rows = bpe.encode(texts)
        columns = [
            pa.array([len(r) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(r).hexdigest() for r in rows], pa.string()),
            pa.array([hashlib.sha256(bpe.decode(r.tolist()).encode()).hexdigest() for r in rows], pa.string()),
        ]
        return columns + [pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32()))] * keep_ids

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return _mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], schema, work)
