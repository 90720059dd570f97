"""Alignment of two tokenizers' ids over the same bytes.

Both token lists of a text have cumulative byte ends. A dictionary from end to index for each list, the intersection of
their keys as hash sets, and the common ends in order cut both lists into groups; a link joins every token of a group's
one side with every token of its other side.

Texts are cut into runs where both tokenizers surely have an end: before a space or line feed behind a character that
isn't white space (see `cuts`). Each distinct run is encoded and aligned once, many runs in one call, and a bounded cache
keeps it; a text's groups are those of its runs, one after the other. Tests compare this with whole texts.

How many documents hold a pair linked is counted by Spark. A task gives a row for each slice of documents: the
slice's distinct pairs with the number of its documents, and for each document the pairs it holds and how often. Only a slice's
distinct pairs are shuffled by pair, and each slice gets the counts of its own pairs back.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import store
from tessera.llm.rank_bpe import byte_symbols
from tessera.llm.textarrow import buffers, distinct, slices, tidied

#: Fixed values of the second vocabulary's pieces: what stands for a space.
PIECE_SPACE = "▁"
#: Bytes behind which a space or line feed begins a run: ASCII but controls and white space, and all of UTF-8's.
_SAFE = np.array([0x21 <= b <= 0x7E or b >= 0x80 for b in range(256)])
_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
_SHOWN = np.array([0x21 <= b <= 0x7E for b in range(256)])
_MARK = _SHOWN & ~_LETTER
#: Runs encoded in one call, and the word that stands before those that don't begin with a space.
TOGETHER = 2000
#: Rows of slices in a file: each takes about as much as its text.
SLICES_PER_FILE = 4
#: Runs whose pairs are counted in one step.
COUNTED = 1 << 16
FILLER = b" x"
NO_TOKENS = -1


def _wide(d: np.ndarray) -> np.ndarray:
    """The last bytes of wider white space (U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000), or of something near it."""
    wide = np.zeros(len(d), bool)
    wide[1:] |= (d[:-1] == 0xC2) & ((d[1:] == 0x85) | (d[1:] == 0xA0))
    wide[2:] |= ((d[:-2] == 0xE2) & ((d[1:-1] == 0x80) | (d[1:-1] == 0x81))) | ((d[:-2] == 0xE1) & (d[1:-1] == 0x9A)) | ((d[:-2] == 0xE3) & (d[1:-1] == 0x80))
    return wide


def cuts(d: np.ndarray) -> np.ndarray:
    """Places where a run begins: a space behind a character that is no white space, a line feed between two of which the later is
    visible ASCII, a mark or digit of ASCII behind a letter of ASCII or Latin-1. The first tokenizer's words never reach over such
    a place, nor does its look-ahead after white space; `Pair` checks that no piece of the second does."""
    if len(d) < 2:
        return np.zeros(0, np.int64)
    behind = (_SAFE[d] & ~_wide(d))[:-1]
    ahead = np.append(_SHOWN[d[2:]], False)
    letter = _LETTER[d[:-1]]
    letter[1:] |= (d[:-2] == 0xC3) & (d[1:-1] != 0x97) & (d[1:-1] != 0xB7)
    return np.flatnonzero((behind & ((d[1:] == 0x20) | ((d[1:] == 0x0A) & ahead))) | (letter & _MARK[d[1:]])) + 1


def common_ends(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """The index in each list of every end that both have, in order of the ends."""
    at_a, at_b = {e: i for i, e in enumerate(ends_a)}, {e: i for i, e in enumerate(ends_b)}
    return [(at_a[e], at_b[e]) for e in sorted(at_a.keys() & at_b.keys())]


class Pair:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = {s: b for b, s in enumerate(byte_symbols())}
        self.bytes_a = [b""] * (1 + max(vocab.values()))
        for t, i in vocab.items():
            self.bytes_a[i] = bytes(map(byte.__getitem__, t))
        self.b = SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [self._piece(self.b, i) for i in range(self.b.get_piece_size())]
        over = re.compile(rb"[^ ] |[^\n]\n|\n[^\n]|[A-Za-z][!-@\[-`{-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][!-@\[-`{-~]")
        if any(over.search(t) for i, t in enumerate(self.bytes_b) if not self.b.is_control(i) and not self.b.is_unknown(i)):
            raise ValueError("the second vocabulary has pieces over the ends of runs")
        self.size_a, self.size_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.bytes_a, self.bytes_b))

    @staticmethod
    def _piece(model, i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(PIECE_SPACE, " ").encode()

    def ids_a(self, text: str) -> list[int]:
        """Ids of a text that begins with a space, as it is."""
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def ids_b(self, text: str) -> list[int]:
        """Ids of a text that begins with a space and isn't a space alone: the model adds the space."""
        return self.b.encode(text[1:], num_threads=1)


class Aligner:
    """Aligned runs of this worker. A run's number gives its ids, groups and links; all is dropped when it takes `cache_bytes`.

    Arrays by run: n_a, n_b, n_groups, n_links (NO_TOKENS in n_a where a tokenizer's bytes aren't the run's); `shown` has its
    groups as text, and its linked pairs are codes[first : first + n_codes] with `times`.
    """

    def __init__(self, path_a: str, path_b: str, cache_bytes: int = 96 << 20):
        self.pair, self.cache_bytes = Pair(path_a, path_b), cache_bytes
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.single: dict[int, str] = {}  # groups of one id on each side, as text
        self.shown: list[bytes] = []
        self.counts = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.first, self.n_codes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held = self.run_bytes = 0

    def _learn(self, runs: list[bytes]) -> None:
        # White space at the end of a run (and so of a text) would run on into the next one's.
        d = np.frombuffer(b"".join(runs), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs))) - 1
        closed = (_SAFE[d] & ~_wide(d))[ends]
        order = [*np.flatnonzero(closed).tolist(), *np.flatnonzero(~closed).tolist()]
        n_closed, base = int(closed.sum()), len(self.known)
        parts = [order[at : min(at + TOGETHER, n_closed)] for at in range(0, n_closed, TOGETHER)] + [[i] for i in order[n_closed:]]
        counts, n_codes, pairs, times = [self.counts], [self.n_codes], [self.pairs], [self.times]
        for part in parts:  # what a call finds is packed before the next one
            found = self._aligned([runs[i] for i in part])
            shown, figures, links = zip(*found, strict=True)
            n = np.fromiter(map(len, links), np.int64, len(links))
            self.shown += shown
            self.run_bytes += sum(map(len, shown))
            counts.append(np.array(figures, np.int64))
            n_codes.append(n)
            pairs.append(np.fromiter((p for x in links for p in x), np.int64, n.sum()))
            times.append(np.fromiter((t for x in links for t in x.values()), np.int64, n.sum()))
        self.known.update((runs[i], base + k) for k, i in enumerate(order))
        self.run_bytes += len(d)
        self.counts, self.n_codes, self.pairs, self.times = map(np.concatenate, (counts, n_codes, pairs, times))
        self.first = np.cumsum(self.n_codes) - self.n_codes
        # A dictionary entry, two objects and the arrays' places for each run; an entry and a text for each pair of `single`.
        self.held = 250 * len(self.known) + self.run_bytes + 16 * len(self.pairs) + 200 * len(self.single)

    def _aligned(self, runs: list[bytes]) -> list[tuple[bytes, tuple[int, int, int, int], dict[int, int]]]:
        """Groups as text, figures, and each linked pair with how often it is linked, of each run.

        All runs are one text, with a word before those that don't begin with a space. Where its bytes aren't those of the
        tokens, or a run's end isn't common, halves are tried, at last each run by itself.
        """
        parts = [FILLER]
        for run in runs:
            if run[0] != 0x20:
                parts.append(FILLER)
            parts.append(run)
        whole = b"".join(parts)
        text, ends = whole.decode("utf-8", "replace"), np.cumsum([*map(len, parts)])
        a, b = self.pair.ids_a(text), self.pair.ids_b(text)
        if b"".join(map(self.pair.bytes_a.__getitem__, a)) == whole == b"".join(map(self.pair.bytes_b.__getitem__, b)):
            ends_a, ends_b = np.cumsum(self.pair.size_a[a]), np.cumsum(self.pair.size_b[b])
            common = common_ends(ends_a.tolist(), ends_b.tolist())
            at = ends_a[[i for i, _ in common]]
            last = np.searchsorted(at, ends)
            if last[-1] < len(at) and (at[last] == ends).all():
                own = [k for k in range(1, len(parts)) if parts[k] is not FILLER]
                return [self._entry(a, b, common[last[k - 1] : last[k] + 1]) for k in own]
        if len(runs) > 1:
            half = len(runs) // 2
            return self._aligned(runs[:half]) + self._aligned(runs[half:])
        return [(b"", (NO_TOKENS, 0, 0, 0), {})]

    def _entry(self, a: list[int], b: list[int], ends: list[tuple[int, int]]) -> tuple[bytes, tuple[int, int, int, int], dict[int, int]]:
        """`ends`: the last indices of the run before, then of each group."""
        links: dict[int, int] = {}
        parts, n_links = [], 0
        before_a, before_b = i, j = ends[0]
        for p, q in ends[1:]:
            if p == i + 1 and q == j + 1:
                key = (a[p] << 32) | b[q]
                links[key] = links.get(key, 0) + 1
                n_links += 1
                parts.append(self.single.get(key) or self.single.setdefault(key, f"{a[p]}|{b[q]}"))
            else:
                left, right = a[i + 1 : p + 1], b[j + 1 : q + 1]
                n_links += len(left) * len(right)
                for x in set(left):  # each kind of pair once, times how often its ids come
                    n = left.count(x)
                    for y in set(right):
                        key = (x << 32) | y
                        links[key] = links.get(key, 0) + n * right.count(y)
                parts.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
            i, j = p, q
        return ";".join(parts).encode(), (i - before_a, j - before_b, len(ends) - 1, n_links), links

    def slots(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The runs' numbers of all texts, one text after the other, and the n + 1 offsets. Null and empty texts have none."""
        if self.held > self.cache_bytes:
            self.forget()
        data, offsets = buffers(texts)
        n = len(offsets) - 1
        full = np.flatnonzero(np.diff(offsets) > 0)
        sizes = np.zeros(n, np.int64)
        sizes[full] = np.diff(offsets)[full] + 1
        where = np.concatenate([[0], np.cumsum(sizes)])
        spaced = np.full(where[-1], 0x20, np.uint8)  # a space before each text that isn't empty
        body = np.ones(len(spaced), bool)
        body[where[full]] = False
        spaced[body] = data
        begins = np.zeros(len(spaced) + 1, bool)
        begins[cuts(spaced)] = True
        begins[where] = True
        starts = np.flatnonzero(begins[:-1])
        runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(spaced)).astype(np.int32)), pa.py_buffer(spaced)])
        coded = runs.dictionary_encode()
        own = coded.dictionary.to_pylist()
        fresh = [r for r in own if r not in self.known]
        if fresh:
            self._learn(fresh)
        slot = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
        return slot[coded.indices.to_numpy(zero_copy_only=False)], np.searchsorted(starts, where)

    def held_by(self, slot: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct linked pairs of all texts' runs (those of -1 don't count); for each text, one after the other, the places in
        them of what it holds and how often; how many places each text has; in how many texts each pair is.

        Texts are counted some at a time, as a pair is a place for each text and run on the way.
        """
        used = distinct(slot[slot >= 0])
        per = self.n_codes[used]
        first = np.cumsum(per) - per
        place = np.repeat(self.first[used] - first, per) + np.arange(per.sum())
        pairs, code = np.unique(self.pairs[place], return_inverse=True)
        linked = self.times[place]
        sizes, n_docs = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(pairs), np.int64)
        codes, times = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        at = 0
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + COUNTED, side="right")) - 1)
            runs, text = slot[offsets[at] : offsets[end]], np.repeat(np.arange(at, end), np.diff(offsets[at : end + 1]))
            text, runs = text[runs >= 0], np.searchsorted(used, runs[runs >= 0])
            # Its distinct runs first, then their pairs.
            key, often = np.unique(text * np.int64(max(len(used), 1)) + runs, return_counts=True)
            text, runs = np.divmod(key, max(len(used), 1))
            n = per[runs]
            place = np.repeat(first[runs] - np.cumsum(n) + n, n) + np.arange(n.sum())
            key, inverse = np.unique(np.repeat(text, n) * np.int64(max(len(pairs), 1)) + code[place], return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, inverse, linked[place] * np.repeat(often, n))
            text, found = np.divmod(key, max(len(pairs), 1))
            sizes[at:end] = np.bincount(text - at, minlength=end - at)
            n_docs += np.bincount(found, minlength=len(pairs))
            codes.append(found.astype(np.int32))
            times.append(total)
            at = end
        return pairs, np.concatenate(codes), np.concatenate(times), sizes, n_docs


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[offsets])


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """This worker's aligner."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, groups): the groups of every whole text, each with the ids of both sides.

    Null and empty texts have no groups, nor have those of which a tokenizer's bytes aren't a space and the text. Rows that
    repeat or have no doc_id stay, each by itself; further columns go. An empty table gives none.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in slices(batches, "text", 1 << 20):
            slot, offsets = own.slots(batch.column("text"))
            bad = _sums((own.counts[slot, 0] == NO_TOKENS).astype(np.int64), offsets) > 0
            groups = []
            for i in range(len(bad)):
                shown = b";".join([own.shown[s] for s in slot[offsets[i] : offsets[i + 1]].tolist()]).decode() if not bad[i] else ""
                sides = [[list(map(int, side.split(","))) for side in g.split("|")] for g in shown.split(";")] if shown else []
                groups.append([{"a": x, "b": y} for x, y in sides])
            kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(groups, kind)], ["doc_id", "groups"])

    return _rows(docs).mapInArrow(tidied(work), "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


SLICE = (
    "slice string, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, "
    "sizes array<int>, codes array<int>, times array<long>, pairs array<long>, n_docs array<long>"
)
LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def slices_of(docs: DataFrame, path_a: str, path_b: str, slice_bytes: int = 4 << 20) -> DataFrame:
    """A row for each slice of about `slice_bytes` of text (one document at least): its documents' figures and digests, the
    places in `pairs` of what each holds linked (`sizes` of them, in `codes`) and how often, and in how many of its
    documents each pair is. Slices are named by chance, so write the rows before they are used twice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        own = aligner(path_a, path_b)
        for batch in slices(batches, "text", slice_bytes):
            slot, offsets = own.slots(batch.column("text"))
            n = batch.num_rows
            bad = _sums((own.counts[slot, 0] == NO_TOKENS).astype(np.int64), offsets) > 0
            text_of = np.repeat(np.arange(n), np.diff(offsets))
            counts = np.stack([_sums(own.counts[slot, c], offsets) for c in range(4)])
            counts[:, bad] = 0
            digests = []
            for i, (p, q) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                digests.append(hashlib.sha256(b";".join([own.shown[s] for s in slot[p:q].tolist()])).hexdigest() if q > p and not bad[i] else "")
            pairs, codes, times, sizes, n_docs = own.held_by(np.where(bad[text_of], -1, slot), offsets)
            values = [
                pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column("doc_id")),
                *(_list(c, pa.int64()) for c in counts), _list(digests, pa.string()), _list(sizes, pa.int32()), _list(codes, pa.int32()), _list(times, pa.int64()),
                _list(pairs, pa.int64()), _list(n_docs, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(values, [f.split()[0] for f in SLICE.split(", ")])
        own.forget()  # a worker that waits holds no runs

    return _rows(docs).mapInArrow(tidied(work), SLICE)


def pair_counts(sliced: DataFrame) -> DataFrame:
    """(pair, n_docs, best): in how many documents each pair of ids (a in the upper 32 bits) is linked, and whether no other pair of
    its a is in more."""
    counts = sliced.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.n_docs").alias("n_docs"))
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def linked(docs: DataFrame, path_a: str, path_b: str, slice_bytes: int = 4 << 20) -> DataFrame:
    """A row a document: its tokens, groups and links, over its links the sum of their pairs' counts and how many of them are of
    a best pair, and the digest of its groups (a1,a2|b1;a3|b2,b3).

    A pair's count is how many rows of `docs` hold it linked, so rows that repeat count each. Null and empty texts, and texts of
    which a tokenizer's bytes aren't a space and the text, have zeros and an empty digest. Rows without a doc_id stay. Further
    columns go; an empty table gives none.
    """
    spark = docs.sparkSession
    with store.batches_of(spark, slice_bytes):
        sliced = store.written(slices_of(docs, path_a, path_b, slice_bytes), "aligned-slices", SLICES_PER_FILE)
    counts = store.written(pair_counts(sliced), "pair-counts")
    back = sliced.select(F.col("slice").alias("of"), F.explode("pairs").alias("pair")).join(counts, "pair")

    def work(of_slice: pa.Table, found: pa.Table) -> pa.Table:
        # A slice and the counts of its own pairs, in order of the pairs, as the slice has them.
        row = {c: of_slice.column(c)[0].values for c in of_slice.column_names if c != "slice"}
        offsets = np.concatenate([[0], np.cumsum(row["sizes"].to_numpy(zero_copy_only=False))])
        code, times = (row[c].to_numpy(zero_copy_only=False) for c in ("codes", "times"))
        order = np.argsort(found.column("pair").to_numpy())
        total, best = (_sums(found.column(c).to_numpy().astype(np.int64)[order][code] * times, offsets) for c in ("n_docs", "best"))
        return pa.Table.from_arrays([row["doc_ids"], *(row[c] for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(best), pa.array(total), row["digests"]], [f.split()[0] for f in LINKED.split(", ")])

    return sliced.drop("pairs", "n_docs").groupBy("slice").cogroup(back.groupBy("of")).applyInArrow(work, LINKED)
