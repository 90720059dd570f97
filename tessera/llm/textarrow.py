"""Vectorised word handling on Arrow string columns.

The helpers work on the UTF-8 bytes of a whole batch at once, so a task never loops over
words in Python. Every helper takes whole texts: nulls count as empty texts and words never
run across the boundary of two texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

#: ASCII white space, as in `[\x20\x09-\x0D]`.
ASCII_SPACE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def byte_class(chars: bytes | None = None, *, but: bytes | None = None) -> np.ndarray:
    """A table of 256 booleans: true for the bytes of `chars`, or for all bytes but `but`."""
    table = np.full(256, but is not None)
    table[list(chars if but is None else but)] = but is None
    return table


#: Bytes of words that are divided by ASCII white space.
SPACED = byte_class(but=ASCII_SPACE)
#: Bytes of words made of ASCII digits, a-z and any non-ASCII character (after lower-casing A-Z).
ALNUM = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
#: Lower-cases A-Z and nothing else.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes that begin a code point.
LEAD = np.array([not 0x80 <= b < 0xC0 for b in range(256)])


def release() -> None:
    """Give unused memory back to the system: a worker serves many tasks, and would keep its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work on batches; unused memory goes back when the task ends."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most about `max_bytes` of `column` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their n + 1 offsets; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Spans:
    """Runs of bytes of one class: `starts`, `ends` in `data`; run i of text d has `of[d] <= i < of[d + 1]`.

    `cuts` (n + 1 booleans) marks bytes before which a run ends though both sides are of the class.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, cuts: np.ndarray | None = None):
        inside, n = table[data], len(data)
        first = np.zeros(n + 1, bool) if cuts is None else cuts
        first[offsets] = True
        begins, finishes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:n]
        finishes[:-1] &= ~inside[1:] | first[1:n]
        self.data, self.offsets = data, offsets
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        self.of = np.searchsorted(self.starts, offsets)
        self._inside = inside

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        """Runs of each text."""
        return np.diff(self.of)

    def text_of(self) -> np.ndarray:
        """The text of each run."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def values(self) -> pa.Array:
        """The runs as a binary Arrow array."""
        where = np.zeros(len(self) + 1, np.int32)
        np.cumsum(self.ends - self.starts, out=where[1:])
        return pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(self.data[self._inside]))])

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """A code of each run, exact (equal codes for equal bytes), and the distinct runs by code."""
        if not len(self):
            return np.zeros(0, np.int64), pa.array([], pa.binary())
        coded = self.values().dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def spans(texts: pa.Array, table: np.ndarray, fold: bool = False) -> Spans:
    data, offsets = buffers(texts)
    return Spans(FOLD[data] if fold else data, offsets, table)


def lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All \\n-split lines of all texts: line offsets of each text, starts and ends in the bytes, codes by raw bytes.

    An empty text has one empty line.
    """
    data, offsets = buffers(texts)
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    per = np.diff(np.searchsorted(breaks, offsets)) + 1
    of = np.zeros(n + 1, np.int64)
    np.cumsum(per, out=of[1:])
    starts, ends = np.empty(of[-1], np.int64), np.empty(of[-1], np.int64)
    head, tail = np.zeros(of[-1], bool), np.zeros(of[-1], bool)
    head[of[:-1]] = True
    tail[of[1:] - 1] = True
    starts[head], starts[~head] = offsets[:-1], breaks + 1
    ends[tail], ends[~tail] = offsets[1:], breaks
    where = np.zeros(of[-1] + 1, np.int32)
    np.cumsum(ends - starts, out=where[1:])
    kept = pa.Array.from_buffers(pa.binary(), int(of[-1]), [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(data[data != 10]))])
    codes = kept.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if of[-1] else np.zeros(0, np.int64)
    return of, starts, ends, codes


def dense_ranks(keys: np.ndarray) -> np.ndarray:
    """Exact ranks 0, 1, ... of integer keys, equal for equal keys."""
    if not len(keys):
        return keys.astype(np.int64)
    order = np.argsort(keys)
    ordered = keys[order]
    step = np.empty(len(keys), np.int64)
    step[0] = 0
    np.cumsum(ordered[1:] != ordered[:-1], out=step[1:])
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = step
    return ranks


def distinct(keys: np.ndarray) -> np.ndarray:
    """Integer keys in order, each once."""
    ordered = np.sort(keys)
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    return ordered[first]


def hash_words(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each distinct word, the same in every task."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(v, seed) for v in values.to_pylist()), np.uint64, len(values))
