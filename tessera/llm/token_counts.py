"""Exact token counts by a compiled finite-state transducer whose chunk state maps compose.

The tokenizer is compiled, not called. The transducer reads the bytes of a piece of the pre-tokenizer, the last one
marked as such, and goes back to its start state there. A state has, for each place where a token that is still being
read may have begun, what that token has so far, the token that ends before it, and how many tokens stand before it,
counted from the least; a transition emits what that least number grows by. Which token ends at a place is decided by
pairs: tokens are the encoding of a text if and only if each pair of neighbours, taken alone, is encoded as that pair,
because up to the first merge across a border the least merges by rank and place inside a pair are the same in the text
and in the pair alone. There are finitely many states, as a token has a longest length; states and transitions are
compiled when they are first met, and the state map of a whole word, from the start state to itself, is kept as well.

White space, and places beside ASCII digits and punctuation that no special string holds, bring the transducer back to
its start state whatever stands around them: they are resets. So a chunk of a text maps a state to a state and a count
by three values: what stands before its first reset (it continues whatever the chunk before left open), the tokens
emitted between the first and the last reset, and what stands after the last. Such maps compose associatively: long
texts are cut into chunks, which are dealt over tasks and composed in a tree of FAN maps a node.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import materialise, partitions
from tessera.llm.texts import WHITE_SPACE, file_bytes, held, slices

#: Texts of more characters are cut into chunks of so many.
CHUNK = 32_768
#: Maps of chunks that compose in one group.
FAN = 64
LAST, SYMBOLS, EMITTED = 256, 512, 1024
#: Compiled transitions and states, words and pairs that a worker keeps; beyond, it starts anew.
MOST_TRANSITIONS, MOST_STATES, MOST_WORDS, MOST_PAIRS = 800_000, 150_000, 300_000, 400_000
_SPACE = str.maketrans(dict.fromkeys(WHITE_SPACE, " "))
#: Control characters that Python's split() takes for white space and the tokenizer does not.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"


def _odd(text: str) -> bool:
    return any(c in text for c in _NOT_SPACE)


class Transducer:
    """States and transitions over bytes of a piece, with the number of tokens that each transition emits."""

    def __init__(self, path: str):
        spec = json.loads(file_bytes(path))
        model = spec["model"]
        vocab = model["vocab"]
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        #: Strings that the tokenizer takes for one token wherever they stand in a text as given.
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)").split
        end = model["end_of_word_suffix"]
        self.size = 1 + max(vocab.values())
        shown = _byte_characters()
        byte_of = {c: b for b, c in enumerate(shown)}
        #: Symbols are bytes, and bytes + LAST for the last of a piece.
        self.symbol_ids = [vocab[c] for c in shown] + [vocab[c + end] for c in shown]
        self.merges = {vocab[a] * self.size + vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.symbols: dict[int, tuple[int, ...]] = {}
        #: The tree of all tokens by symbols: child by node * SYMBOLS + symbol, token by node.
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.inner: set[int] = set()
        for name, number in vocab.items():
            last = name.endswith(end) and len(name) > len(end)
            text = name[: -len(end)] if last else name
            if not all(c in byte_of for c in text):
                continue  # special strings are no tokens of pieces
            symbols = [byte_of[c] for c in text]
            symbols[-1] += LAST * last
            self.symbols[number] = tuple(symbols)
            node = 0
            for x in symbols:
                self.inner.add(node)
                at = node * SYMBOLS + x
                if at not in self.child:
                    self.child[at] = len(self.token)
                    self.token.append(-1)
                node = self.child[at]
            self.token[node] = number
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, int] = {}
        self.restart()

    def restart(self) -> None:
        """Only the start state, without transitions."""
        self.states: list[tuple[tuple[int, int, int], ...]] = [((0, -1, 0),)]
        self.numbers = {self.states[0]: 0}
        #: By state * SYMBOLS + symbol: the next state * EMITTED + tokens emitted.
        self.transitions: dict[int, int] = {}

    def trim(self) -> None:
        """Start anew where too much is kept."""
        if len(self.transitions) > MOST_TRANSITIONS or len(self.states) > MOST_STATES:
            self.restart()
        for table, most in ((self.words, MOST_WORDS), (self.pairs, MOST_PAIRS)):
            if len(table) > most:
                table.clear()

    def encoded(self, symbols: Iterable[int]) -> list[int]:
        """The tokens of a few symbols: the leftmost pair of lowest rank merges until none does."""
        ids = [self.symbol_ids[x] for x in symbols]
        while True:
            found = [(m[0], i, m[1]) for i in range(len(ids) - 1) if (m := self.merges.get(ids[i] * self.size + ids[i + 1]))]
            if not found:
                return ids
            _, i, merged = min(found)
            ids[i : i + 2] = [merged]

    def holds(self, before: int, token: int) -> bool:
        """Whether a token stays as it is behind another one; at the start of a piece (-1), whether it does at all."""
        key = before * self.size + token
        if key not in self.pairs:
            want = [token] if before < 0 else [before, token]
            self.pairs[key] = self.encoded(x for t in want for x in self.symbols[t]) == want
        return self.pairs[key]

    def compile(self, state: int, symbol: int) -> int:
        """The transition from a state by a symbol."""
        reading, ends = [], None
        for node, before, count in self.states[state]:
            at = self.child.get(node * SYMBOLS + symbol)
            if at is None:
                continue
            if at in self.inner:
                reading.append((at, before, count))
            token = self.token[at]
            if ends is None and token >= 0 and self.holds(before, token):
                ends = (token, count + 1)
        token, count = ends
        if symbol >= LAST:
            to, emitted = 0, count
        else:
            reading.append((0, token, count))
            emitted = min(c for _, _, c in reading)
            key = tuple((n, t, c - emitted) for n, t, c in reading)
            to = self.numbers.setdefault(key, len(self.states))
            if to == len(self.states):
                self.states.append(key)
        made = to * EMITTED + emitted
        self.transitions[state * SYMBOLS + symbol] = made
        return made

    def run(self, piece: str) -> int:
        """Tokens that are emitted on the way over a piece."""
        raw = piece.encode()
        get, state, total = self.transitions.get, 0, 0
        for x in raw[:-1]:
            made = get(state * SYMBOLS + x)
            if made is None:
                made = self.compile(state, x)
            state = made // EMITTED
            total += made % EMITTED
        made = get(state * SYMBOLS + raw[-1] + LAST)
        return total + (self.compile(state, raw[-1] + LAST) if made is None else made) % EMITTED

    def annotate(self, words: Iterable[str]) -> None:
        """The state maps of whole words."""
        for w in words:
            self.words[w] = sum(map(self.run, self.pieces(w)))

    def resets(self, text: str) -> list[str]:
        """The words between white space of a text, normalised; a final sigma is not treated apart."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        lowered = text.replace("Σ", "σ").lower()
        return lowered.translate(_SPACE).split(" ") if _odd(lowered) else lowered.split()


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files of byte-level tokenizers."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


def transducer(path: str) -> Transducer:
    return held(f"transducer {path}", lambda: Transducer(path))


def _count(machine: Transducer, texts: list[str]) -> list[int]:
    """Tokens of texts that begin and end at a reset. Special strings are one token each and resets besides."""
    parts = [machine.cut(t) if any(x in t for x in machine.special) else [t] for t in texts]
    split = [[w for part in p for w in machine.resets(part)] for p in parts]
    machine.trim()
    # Membership, not a difference of sets: that would walk through the whole table for every call.
    new = {w for words in split for w in words if w not in machine.words}
    if new:
        machine.annotate(new)
    emitted = machine.words.__getitem__
    return [sum(map(emitted, words)) + len(p) - 1 for words, p in zip(split, parts, strict=True)]


# Of characters that stand in no special string and in no contraction: white space, and the places beside ASCII digits
# and punctuation where a piece ends whatever else the text holds.
_PUNCTUATION = r"!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~"
_EDGE = regex.compile(f"[{WHITE_SPACE}]|(?<=[0-9])(?=[\\x21-\\x7e])|(?<=[^{WHITE_SPACE}])(?=[0-9])|(?<=[{_PUNCTUATION}])(?=[A-Za-z])|(?<=[A-Za-z])(?=[{_PUNCTUATION}])")


def chunk_map(text: str) -> tuple[str, str | None, str]:
    """(before the first reset, between, after the last reset); between is None where there is no reset."""
    first = _EDGE.search(text)
    if not first:
        return text, None, ""
    # The last reset is looked for in ever longer ends of the chunk.
    reach, last = 256, None
    while last is None:
        for last in _EDGE.finditer(text, max(first.start(), len(text) - reach)):
            pass
        reach *= 8
    return text[: first.start()], text[first.start() : last.end()], text[last.end() :]


def compose(machine: Transducer, maps: list[tuple[str, int | None, str]]) -> tuple[str, int | None, str]:
    """The map of consecutive chunks."""
    head, inner, tail = maps[0]
    open_ = [head] if inner is None else [tail]
    for head2, inner2, tail2 in maps[1:]:
        open_.append(head2)
        if inner2 is None:
            continue
        if inner is None:
            head, inner = "".join(open_), inner2
        else:
            inner += inner2 + _count(machine, ["".join(open_)])[0]
        open_ = [tail2]
    return ("".join(open_), None, "") if inner is None else (head, inner, "".join(open_))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """UTF-8 bytes and tokens of every whole text of ``docs``, as the tokenizer file at ``path`` counts them.

    Returns one row (id, n_bytes, n_tokens) for each row of ``docs``. Null and empty texts have no tokens. Texts
    longer than ``chunk`` are cut into chunks, which are dealt over all tasks; their state maps, short unless a text
    has no reset for long, are composed FAN at a time, level by level. Equal texts have equal counts; null and repeated
    ids are rows like any other; other columns are ignored. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Nearly all texts are one chunk: their map ends at the edges of the text and needs no composition.
    whole = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    short = whole.filter(F.length("text") <= chunk)
    long = whole.filter(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    kind = dict(whole.dtypes)["doc_id"]

    def count_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for part, texts in slices(batches):
            counted = pa.array(_count(machine, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), counted], ["doc_id", "n_bytes", "n_tokens"])

    def map_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for part, texts in slices(batches):
            cut = [chunk_map(t) for t in texts]
            counts = iter(_count(machine, [c[1] for c in cut if c[1] is not None]))
            inner = [None if c[1] is None else next(counts) for c in cut]
            columns = [part.column(0), part.column(1), part.column(2), part.column(3), pa.array([c[0] for c in cut], pa.string()), pa.array(inner, pa.int64()), pa.array([c[2] for c in cut], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_bytes", "nth", "head", "inner", "tail"])

    def join_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            joined = [compose(machine, [(m["head"], m["inner"], m["tail"]) for m in maps]) for maps in batch.column("maps").to_pylist()]
            values = [pa.array([j[i] for j in joined], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "doc_id", "n_bytes", "nth")], *values], ["row", "doc_id", "n_bytes", "nth", "head", "inner", "tail"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for b in batches:
            ends = _count(machine, [x or "" for c in ("head", "tail") for x in b.column(c).to_pylist()])
            totals = [(n or 0) + ends[i] + ends[b.num_rows + i] for i, n in enumerate(b.column("inner").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = f"doc_id {kind}, n_bytes bigint, n_tokens bigint"
    counted = short.mapInArrow(count_whole, out)
    starts = F.sequence(F.lit(1), F.length("text"), F.lit(chunk))
    cut = long.select("row", "doc_id", "n_bytes", F.posexplode(F.transform(starts, lambda s: F.substring(F.col("text"), s, F.lit(chunk)))).alias("nth", "text"))
    schema = f"row bigint, doc_id {kind}, n_bytes bigint, nth int, head string, inner bigint, tail string"
    cut = cut.repartition(partitions(docs.sparkSession), "row", "nth")
    maps = materialise(cut.mapInArrow(map_chunks, schema), "chunk-maps")
    chunks = (maps.agg(F.max("nth")).first()[0] or 0) + 1
    while chunks > 1:
        node = F.floor(F.col("nth") / FAN).cast("int").alias("nth")
        level = maps.groupBy("row", "doc_id", "n_bytes", node).agg(F.sort_array(F.collect_list(F.struct(F.col("nth").alias("at"), "head", "inner", "tail"))).alias("maps"))
        maps, chunks = materialise(level.mapInArrow(join_maps, schema), "chunk-maps"), -(-chunks // FAN)
    return counted.unionByName(maps.mapInArrow(close, out))
