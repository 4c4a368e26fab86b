"""Cutting texts where a tokenizer's pre-tokenizer always cuts, and remembering each piece's result.

Byte-level pre-tokenizers start a new piece at every space that stands before a character
that is not white space. So a text may be cut there, and each chunk encoded by itself;
equal chunks, which are most of a corpus, are encoded once a worker.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa

_SPACE_RUN = re.compile(r" \s")
_BEFORE_WORD = re.compile(r"(?= \S)")
#: Entries of one generation of a memo, and the longest texts that are remembered; both bound a worker's memory,
#: also for scripts without spaces, and not the results.
MEMO_ENTRIES, LONGEST_KEY = 600_000, 64
#: Rows of one output batch, so that a batch of long texts stays small.
ROWS_OUT = 256


_HELD: dict[Hashable, Any] = {}


def release() -> None:
    """Forget what an operator holds in this worker: Spark uses workers again, and the next one needs the memory."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What an operator keeps between tasks of a worker; it is forgotten when another one asks for its own."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


class Memo(dict):
    """A dict that computes missing values and holds two generations of them.

    When the young generation is full it becomes the old one, and the old one is
    forgotten but for what is asked for again meanwhile. Values of long texts are computed
    each time.
    """

    def __init__(self, compute: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.compute, self.entries, self.old = compute, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if isinstance(key, str) and len(key) > LONGEST_KEY:
                return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ChunkMemo:
    """Joins the bytes that ``encode`` gives for each chunk of a text; ``spaced`` gives those of a chunk with a space before it."""

    def __init__(
        self, encode: Callable[[str], bytes], whole: Callable[[str], bool] | None = None, spaced: Callable[[str], bytes] | None = None, entries: int = MEMO_ENTRIES
    ):
        self.encode, self.whole = encode, whole
        self.chunk = Memo(encode, entries)
        self.spaced = Memo(spaced or (lambda part: encode(" " + part)), entries)

    def __call__(self, text: str) -> bytes:
        if self.whole is not None and self.whole(text):
            return self.encode(text)
        if _SPACE_RUN.search(text) or text.endswith(" "):
            return b"".join(map(self.chunk.__getitem__, _BEFORE_WORD.split(text)))
        first, *rest = text.split(" ")
        return (self.chunk[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as it is, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        letters.setdefault(b, chr(0x100 + len(letters) - len(shown)))
    return [letters[b] for b in range(256)]


def text_batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Small batches with the texts of one column; null counts as empty."""
    for batch in batches:
        pa.default_memory_pool().release_unused()
        for at in range(0, batch.num_rows, ROWS_OUT):
            part = batch.slice(at, ROWS_OUT)
            yield part, [x or "" for x in part.column(column).to_pylist()]


def with_columns(batch: pa.RecordBatch, drop: str, **columns: pa.Array) -> pa.RecordBatch:
    """``batch`` without ``drop`` and with more columns at its end."""
    names = [n for n in batch.schema.names if n != drop]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns.values()], [*names, *columns])
