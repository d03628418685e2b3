"""Small helpers for operators that read whole texts inside Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa

#: The Unicode White_Space characters; fixed values.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: Python work goes over slices of about so many characters, so that memory is bounded by a text, not a batch.
SLICE_CHARS = 1_000_000


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches, with their texts (null: empty), of about SLICE_CHARS characters each."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        begin = chars = 0
        values: list[str] = []
        for i in range(batch.num_rows):
            value = column[i].as_py() or ""
            values.append(value)
            chars += len(value)
            if chars >= SLICE_CHARS or i == batch.num_rows - 1:
                yield batch.slice(begin, i + 1 - begin), values
                begin, chars, values = i + 1, 0, []


_HELD: dict[str, object] = {}


def held(name: str, build: Callable[[], Any]) -> Any:
    """What a worker keeps from task to task, such as a table of known words: of one operator at a time.

    Workers outlive stages; what the last operator kept goes when the next one begins, so that their tables don't add up.
    """
    if name not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[name] = build()
        give_back()
    return _HELD[name]


def give_back() -> None:
    """Return memory that is free to the system: Python and the C library keep it for themselves otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def file_bytes(path: str) -> bytes:
    return Path(path).read_bytes()


class Known:
    """What a worker has worked out, by key, and behind it the generation before; each of about ``most`` bytes."""

    def __init__(self, most: int) -> None:
        self.now: dict = {}
        self.before: dict = {}
        self.most, self.size = most, 0

    def missing(self, wanted: set) -> set:
        """What of ``wanted`` neither generation has; what the one before has comes to the front. Call before each slice."""
        if self.size > self.most:
            self.before, self.now, self.size = self.now, {}, 0
        return self.absent(wanted)

    def absent(self, wanted: set) -> set:
        """The same within a slice."""
        absent = {w for w in wanted if w not in self.now}
        old = {w for w in absent if w in self.before}
        for w in old:
            self.add(w, self.before[w], 0)
        return absent - old

    def add(self, key: Any, value: Any, size: int) -> None:
        """Keep an entry that takes ``size`` bytes besides what a key, a value and a place in a table take."""
        self.now[key] = value
        self.size += size + 200
