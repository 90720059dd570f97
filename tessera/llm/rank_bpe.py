"""BPE encoding and decoding by contiguous rank arrays.

A word is an array of parts and an array of the ranks of adjacent parts. The least rank (the leftmost, if several
are least) is found by a scan, the boundary there is deleted, and the two ranks beside it are looked up anew, until no
adjacent parts can be merged. Words of equal length are handled together, a row a word of one matrix of parts and one of
ranks, so each step scans all of them at once. A scan a merge costs the square of a word's length; words longer than
`SHORT` symbols keep their ranks in a heap instead, with the same result.

Texts are cut into runs by tessera.llm.bpe; each distinct run is encoded once, and a bounded cache keeps it. What the
vocabulary file says about normalising non-ASCII characters and about the pattern of words is left to the tokenizers
library's own normaliser and splitter, so that Unicode versions can't differ; merging and decoding are done here.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import RunEncoder
from tessera.llm.textarrow import slices, tidied

SHORT = 64
NONE = np.int32(2**31 - 1)

#: ASCII words of the vocabulary's pattern.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^ \t\n\x0b\x0c\rA-Za-z0-9]+")


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in the vocabulary: itself if printable, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """A vocabulary's merges: rank and result of each pair of ids."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.keys, self.ranks = pairs[order], order.astype(np.int32)
        self.results = np.array([vocab[a + b] for a, b in merges], np.int32)
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of adjacent parts; NONE where they can't be merged."""
        want = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids, one word after the other, and the n + 1 offsets."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[data]
        symbols[ends[sizes > 0] - 1] = self.last[data[ends[sizes > 0] - 1]]
        begins, counts, found = ends - sizes, np.zeros(len(words), np.int64), []
        for n in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == n)
            if n <= SHORT:
                ids, counts[rows] = self._short(symbols[begins[rows][:, None] + np.arange(n)])
                found.append((rows, ids[np.arange(n) < counts[rows][:, None]]))
            else:
                for r in rows.tolist():
                    ids = self._long(symbols[begins[r] : ends[r]].tolist())
                    counts[r] = len(ids)
                    found.append((np.array([r]), np.array(ids, np.int32)))
        offsets = np.zeros(len(words) + 1, np.int64)
        np.cumsum(counts, out=offsets[1:])
        out = np.empty(offsets[-1], np.int32)
        for rows, ids in found:
            n = counts[rows]
            out[np.repeat(offsets[rows] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        return out, offsets

    def _short(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of equally many symbols, merged; how many parts are left of each."""
        out, counts, rows = parts.copy(), np.ones(len(parts), np.int64), np.arange(len(parts))
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        while ranks.shape[1]:
            line = np.arange(len(rows))
            j = ranks.argmin(1)
            rank = ranks[line, j]
            done = rank == NONE
            if done.any():
                out[rows[done], : parts.shape[1]], counts[rows[done]] = parts[done], parts.shape[1]
                rows, parts, ranks, j, rank = rows[~done], parts[~done], ranks[~done], j[~done], rank[~done]
                if not len(rows):
                    return out, counts
                line = line[: len(rows)]
            # Delete the boundary between parts j and j + 1.
            parts[line, j] = self.results[rank]
            column = np.arange(parts.shape[1] - 1)
            parts = np.take_along_axis(parts, column + (column > j[:, None]), 1)
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column + (column >= j[:, None]), 1)
            # Refresh the ranks on both sides of the new part.
            for side in (-1, 0):
                at = np.flatnonzero((j + side >= 0) & (j + side < ranks.shape[1]))
                left = j[at] + side
                ranks[at, left] = self.rank(parts[at, left], parts[at, left + 1])
        out[rows, :1] = parts
        return out, counts

    def _long(self, ids: list[int]) -> list[int]:
        """One long word: the same merges, the least rank from a heap, neighbours by links."""
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        known = {k: r for k, r in zip(self.keys.tolist(), self.ranks.tolist(), strict=True)} if not hasattr(self, "_known") else self._known
        self._known = known
        live = [0] * n  # counts changes of the pair that begins at a place
        heap = [(r, i, 0) for i in range(n - 1) if (r := known.get((ids[i] << 32) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, version = heapq.heappop(heap)
            if live[i] != version:
                continue
            gone = after[i]
            ids[i], after[i] = int(self.results[rank]), after[gone]
            live[gone] = -1
            if after[i] >= 0:
                before[after[i]] = i
            for p in (before[i], i):
                if p >= 0:
                    live[p] += 1
                    if after[p] >= 0 and (r := known.get((ids[p] << 32) | ids[after[p]])) is not None:
                        heapq.heappush(heap, (r, p, live[p]))
        at, out = 0, []
        while at >= 0:
            out.append(ids[at])
            at = after[at]
        return out


class RankEncoder(RunEncoder):
    """Ids of texts by `Merges`; runs and their cache are RunEncoder's."""

    def __init__(self, path: str, cache_bytes: int = 96 << 20, longest_cached: int = 64):
        super().__init__(path, cache_bytes, longest_cached)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merges = Merges(model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.symbol_byte = {s: b for b, s in enumerate(byte_symbols())}
        self.tokens = np.full(1 + max([*model["vocab"].values(), *self.special.values()]), None, object)
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            self.tokens[i] = t
        self.tokens = self.tokens.tolist()

    def _words(self, run: bytes) -> list[bytes]:
        """The words of a run that holds no special token, as bytes of their normalised form."""
        if run.isascii():
            return [w.encode() for w in ASCII_WORDS.findall(run.decode().lower())]
        shown = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(run.decode("utf-8", "replace")))
        return [bytes(map(self.symbol_byte.__getitem__, w)) for w, _ in shown]

    def _pieces(self, run: bytes) -> list[bytes | int]:
        """Words, and ids of the special tokens between them."""
        if b"<|" not in run:
            return self._words(run)
        out, at, text = [], 0, run.decode("utf-8", "replace")
        for m in self.cut.finditer(text):
            out += [*self._words(text[at : m.start()].encode()), self.special[m.group()]]
            at = m.end()
        return out + self._words(text[at:].encode())

    def _learn(self, runs: list[bytes]) -> list[int]:
        number: dict[bytes | int, int] = {}
        codes, counts = [], []
        for run in runs:
            pieces = self._pieces(run)
            counts.append(len(pieces))
            codes += [number.setdefault(p, len(number)) for p in pieces]
        words = list(number)
        plain = [p if isinstance(p, bytes) else b"\0" for p in words]
        ids, offsets = self.merges.encode(plain)
        for i, p in enumerate(words):
            if isinstance(p, int):  # one symbol, and so one id
                ids[offsets[i]] = p
        code = np.array(codes, np.int64)
        per = np.diff(offsets)[code]
        got = ids[np.repeat(offsets[code] - np.cumsum(per) + per, per) + np.arange(per.sum())]
        ends = np.concatenate([[0], np.cumsum(per)])
        last = np.cumsum(counts)
        sizes = ends[last] - ends[last - counts]
        n, total, at = len(runs), int(sizes.sum()), self.used_runs
        self.begin, self.size = self._room(self.begin, at + n), self._room(self.size, at + n)
        self.ids = self._room(self.ids, self.used_ids + total)
        self.size[at : at + n] = sizes
        self.begin[at : at + n] = self.used_ids + np.cumsum(sizes) - sizes
        self.ids[self.used_ids : self.used_ids + total] = got
        self.used_ids += total
        self.used_runs += n
        return list(range(at, at + n))

    def decode(self, ids: list[int]) -> str:
        """The vocabulary names no decoder: tokens are joined by a space; ids it doesn't have are left out."""
        n = len(self.tokens)
        return " ".join([t for i in ids if 0 <= i < n and (t := self.tokens[i]) is not None])


_ENCODERS: dict[str, RankEncoder] = {}


def encoder(path: str) -> RankEncoder:
    """This worker's encoder."""
    if path not in _ENCODERS:
        _ENCODERS[path] = RankEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids): the ids of every whole text, without special tokens of its own.

    The strings of special tokens inside a text are their ids, as for the library. Null and empty texts have no ids. Rows that
    repeat or have no doc_id stay, each by itself; further columns go. An empty table gives none.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_ = encoder(tokenizer)
        for batch in slices(batches, "text", 4 << 20):
            ids, offsets = encode_(batch.column("text"), -1 & 0xFFFFFFFF)
            n = len(offsets) - 1
            body = np.ones(len(ids), bool)
            body[offsets[1:] - 1] = False  # the end mark after each text
            where = (offsets - np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(where), pa.array(ids[body].astype(np.int32)))], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(work), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, rows: int = 500) -> DataFrame:
    """(doc_id, ids, text): texts of ids, special tokens included. Null ids give an empty text; ids that the vocabulary doesn't
    have are left out, as the library does."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = encoder(tokenizer).decode
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = [text(i or []) for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidied(work), "doc_id long, ids array<int>, text string")
