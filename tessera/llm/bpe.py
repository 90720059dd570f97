"""Whole texts to token ids with the public tokenizers library.

The vocabulary's pre-tokenizer never joins characters across white space, nor an ASCII letter
and a following full stop or comma; its normaliser lower-cases and works within runs of other
characters; and its special tokens hold no white space. So the ids of a text are those of its
runs, one after the other. Each distinct run is encoded once for each batch, or not at all if
a bounded cache still holds it. tests/llm compares this with the library's ids of whole texts.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from tessera.llm.textarrow import FOLD, Spans, buffers, byte_class

#: Runs are cut at these; all are white space for the vocabulary's patterns.
_CUT = byte_class(but=b" \t\n\r")
_LETTER = byte_class(bytes(range(65, 91)) + bytes(range(97, 123)))
_STOP = byte_class(b".,;:!?")
#: Stands between runs that are encoded together; runs that hold it are encoded alone.
_MARK = "\x01"


def _runs(texts: pa.Array) -> Spans:
    data, offsets = buffers(texts)
    cuts = np.zeros(len(data) + 1, bool)
    cuts[1:-1] = _LETTER[data[:-1]] & _STOP[data[1:]]
    # The strings of special tokens count only as they are written: then nothing is folded.
    return Spans(data if b"<|" in data.tobytes() else _folded(data), offsets, _CUT, cuts)


def _folded(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased but before a byte that isn't ASCII. The normaliser composes before it lower-cases,
    and a small letter may compose with the marks behind it where the capital doesn't."""
    out = FOLD[data]
    kept = np.flatnonzero(data[1:] >= 128)
    out[kept] = data[kept]
    return out


class RunEncoder:
    """Encodes batches of texts; the cache of runs is dropped whole when it takes `cache_bytes`."""

    def __init__(self, path: str, cache_bytes: int = 96 << 20, longest_cached: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self._ids(_MARK)
        self.cache_bytes, self.longest = cache_bytes, longest_cached
        self.known: dict[bytes, int] = {}
        self._reset()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _reset(self) -> None:
        self.known.clear()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.used_ids = self.used_runs = 0

    def _held(self) -> int:
        """About the bytes of the cache: its arrays, and a dictionary entry with its key and number for each run."""
        return self.ids.nbytes + self.begin.nbytes + self.size.nbytes + 200 * len(self.known)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])

    def _learn(self, runs: list[bytes]) -> list[int]:
        words = [r.decode("utf-8", "replace") for r in runs]
        if any(_MARK in w for w in words):
            flat = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            sizes, got = np.array([len(x) for x in flat], np.int64), np.concatenate(flat)
        else:
            got = np.array(self._ids(f" {_MARK} ".join([*words, ""])), np.uint32)
            ends = np.flatnonzero(got == self.mark)
            sizes, got = np.diff(ends, prepend=-1) - 1, got[got != self.mark]
        n, total, at = len(runs), int(sizes.sum()), self.used_runs
        self.begin, self.size = self._room(self.begin, at + n), self._room(self.size, at + n)
        self.ids = self._room(self.ids, self.used_ids + total)
        self.size[at : at + n] = sizes
        self.begin[at : at + n] = self.used_ids + np.cumsum(sizes) - sizes
        self.ids[self.used_ids : self.used_ids + total] = got
        self.used_ids += total
        self.used_runs += n
        return list(range(at, at + n))

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, `end_id` after each text, and the n + 1 offsets of the texts' ids."""
        cut = _runs(texts)
        codes, distinct = cut.codes()
        runs = distinct.to_pylist()
        if self._held() > self.cache_bytes:
            self._reset()
        slots = np.fromiter((self.known.get(r, -1) for r in runs), np.int64, len(runs))
        new = np.flatnonzero(slots < 0)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            fresh = [runs[i] for i in part]
            slots[part] = got = self._learn(fresh)
            self.known.update((r, s) for r, s in zip(fresh, got, strict=True) if len(r) <= self.longest)
        slot = slots[codes]
        sizes = self.size[slot]
        n = len(cut.offsets) - 1
        ends = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        offsets = ends[cut.of] + np.arange(n + 1)
        out = np.full(int(offsets[-1]), end_id, np.uint32)
        body = np.ones(len(out), bool)
        body[offsets[1:] - 1] = False
        out[body] = self.ids[np.repeat(self.begin[slot] - ends[:-1], sizes) + np.arange(ends[-1])]
        return out, offsets


_ENCODERS: dict[str, RunEncoder] = {}


def encoder(path: str) -> RunEncoder:
    """This worker's encoder: it and its cache serve all tasks that the worker runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = RunEncoder(path)
    return _ENCODERS[path]


def crc32_of_slices(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of slices of ids as little-endian unsigned 32-bit integers."""
    import zlib

    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return np.fromiter((zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)), np.int64, len(begins))
