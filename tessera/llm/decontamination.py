"""Benchmark decontamination with an FM-index for each training shard.

A shard is a slice of a task's documents. Its words are numbered; words that no test phrase has,
and the ends of documents, are separators no phrase can hold, and runs of words shorter than the
shortest phrase are left out, so the index has every place where a phrase can be. Over these runs:

* suffixes are ranked by prefix doubling, each separator smaller than any word and unlike any other;
* the Burrows-Wheeler transform is kept in a wavelet matrix with rank directories;
* all phrases are searched backward at once, two ranks a word;
* occurrences are located by stepping back to the nearest sampled suffix position.

Occurrences are merged into spans. Test phrases are prepared by tasks in blocks of bounded size,
files in the shared folder. A shard's index is built once, and all blocks are searched in it, one
after the other; the driver has the blocks' names and a bitmap of fixed size that says which words
may be in a phrase (a word that is let through by chance is only one more word in the index).
"""

from __future__ import annotations

import pickle
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import files, store
from tessera.llm.textarrow import ALNUM, Spans, dense_ranks, hash_words, slices, spans, tidied


class Ranks:
    """A bitmap with a rank directory: `before(i)` is the number of ones among the first i bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.directory = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def before(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        low = self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.directory[word] + np.bitwise_count(low)


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bitmap for each bit of the symbols, highest first."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            one = (sequence >> b & 1).astype(bool)
            self.levels.append(Ranks(one))
            self.zeros.append(int(len(one) - one.sum()))
            sequence = np.concatenate([sequence[~one], sequence[one]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first i places."""
        low = np.zeros_like(i)
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            one = (symbol >> b & 1).astype(bool)
            l, r = self.levels[k].before(low), self.levels[k].before(i)
            low, i = np.where(one, self.zeros[k] + l, low - l), np.where(one, self.zeros[k] + r, i - r)
        return i - low

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it occurs before."""
        symbol, low = np.zeros_like(i), np.zeros_like(i)
        for k in range(self.bits):
            l, r, after = self.levels[k].before(low), self.levels[k].before(i), self.levels[k].before(i + 1)
            one = after > r
            symbol = symbol << 1 | one
            low, i = np.where(one, self.zeros[k] + l, low - l), np.where(one, self.zeros[k] + r, i - r)
        return symbol, i - low


class FMIndex:
    """Runs of symbols 1..sigma, each closed by a separator (0)."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        n = len(text)
        closing = text == 0
        ends = int(closing.sum())
        # Separators differ from each other and sort before all words.
        rank = np.where(closing, np.cumsum(closing) - 1, text + ends - 1)
        rank = self._suffix_ranks(rank.astype(np.int64), sigma + ends + 1)
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        bwt = text[order - 1]
        self.wavelet = WaveletMatrix(bwt.astype(np.int64), max(1, int(sigma).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))]).astype(np.int64)
        # Run starts are sampled too: no step back crosses a separator.
        sampled = (order % sample == 0) | (bwt == 0)
        self.sampled, self.positions = Ranks(sampled), order[sampled]

    @staticmethod
    def _suffix_ranks(rank: np.ndarray, kinds: int) -> np.ndarray:
        n, width = len(rank), 1
        while True:
            step = max(1, 62 // max(1, int(kinds).bit_length()) - 1)  # further parts that fit in 62 bits
            key, base = rank + 1, np.int64(kinds + 1)
            for k in range(1, step + 1):
                part = np.zeros(n, np.int64)
                if k * width < n:
                    part[: n - k * width] = rank[k * width :] + 1
                key = key * base + part
            rank = dense_ranks(key)
            width, kinds = width * (step + 1), int(rank.max()) + 1
            if kinds == n:
                return rank

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each row of `phrases` (equal lengths); empty where low >= high."""
        low, high = self.first[phrases[:, -1]], self.first[phrases[:, -1] + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            c = phrases[live, k]
            low[live], high[live] = self.first[c] + self.wavelet.rank(c, low[live]), self.first[c] + self.wavelet.rank(c, high[live])
        return low, high

    def locate(self, suffixes: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        out, at, steps = np.zeros(len(suffixes), np.int64), suffixes.copy(), np.zeros(len(suffixes), np.int64)
        left = np.arange(len(suffixes))
        while len(left):
            i = at[left]
            before = self.sampled.before(i)
            known = self.sampled.before(i + 1) > before
            done = left[known]
            out[done] = self.positions[before[known]] + steps[done]
            left = left[~known]
            symbol, times = self.wavelet.access(at[left])
            at[left] = self.first[symbol] + times
            steps[left] += 1
        return out


#: Bits of the bitmap of words that may be in a phrase.
VOCABULARY_BITS = 1 << 20


class Phrases:
    """The windows of a block of test items: the words, distinct windows by length, and the items of each."""

    def __init__(self, names: list[str], texts: pa.Array, width: int):
        found = spans(texts, ALNUM, fold=True)
        codes, self.words = found.codes()
        self.names = names
        counts = found.counts()
        per = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
        item = np.repeat(np.arange(len(counts)), per)
        first = np.arange(len(item)) - np.repeat(np.cumsum(per) - per, per) + found.of[:-1][item]
        length = np.minimum(counts, width)[item]
        #: For each length: the distinct windows as words, and the items of window k: owners[of[k] : of[k + 1]].
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(length).tolist():
            mine = np.flatnonzero(length == n)
            table = np.ascontiguousarray(codes[first[mine][:, None] + np.arange(n)], np.int32)
            kind = pa.Array.from_buffers(pa.binary(4 * n), len(mine), [None, pa.py_buffer(table)]).dictionary_encode().indices.to_numpy().astype(np.int64)
            distinct = np.zeros((int(kind.max()) + 1, n), np.int32)
            distinct[kind] = table
            pair = np.unique(kind << 32 | item[mine])
            self.by_length.append((distinct, np.searchsorted(pair >> 32, np.arange(len(distinct) + 1)), pair & 0xFFFFFFFF))
        self.shortest = int(length.min()) if len(length) else 0


@dataclass
class PhraseBlocks:
    """Where the blocks are, the words that may be in a phrase (bits by hash), and the shortest phrase's words."""

    addresses: list[str]
    vocabulary: np.ndarray
    shortest: int

    def may_hold(self, words: pa.Array) -> np.ndarray:
        at = (hash_words(words) % np.uint64(VOCABULARY_BITS)).astype(np.int64)
        return self.vocabulary[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) > 0

    def __iter__(self) -> Iterator[Phrases]:
        for address in self.addresses:
            yield _block(address)


_HELD: OrderedDict[str, tuple[Phrases, int]] = OrderedDict()


def _block(address: str, most_bytes: int = 48 << 20) -> Phrases:
    """A block of phrases; a worker keeps those used last, of so many bytes together."""
    if address in _HELD:
        _HELD.move_to_end(address)
    else:
        raw = files.read(address)
        _HELD[address] = (pickle.loads(raw), len(raw))
        while len(_HELD) > 1 and sum(n for _, n in _HELD.values()) > most_bytes:
            _HELD.popitem(last=False)
    return _HELD[address][0]


def phrase_blocks(benchmark: DataFrame, width: int = 10, block_bytes: int = 4 << 20) -> PhraseBlocks:
    """The test items (item_id, text) in blocks of about `block_bytes` of text (one item at least), dealt by a hash.

    Items without an id or text have no windows. Tasks prepare the blocks; the driver gets their names.
    """
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    folder = files.new_folder(spark, store.new_path(spark, "phrases"))

    def prepare(table: pa.Table) -> pa.Table:
        phrases = Phrases(table["item_id"].to_pylist(), table["text"].combine_chunks(), width)
        address = files.new_name(folder, "block", ".phrases")
        files.write(address, [pickle.dumps(phrases, protocol=5)])
        bits = np.zeros(VOCABULARY_BITS // 64, np.uint64)
        at = hash_words(phrases.words) % np.uint64(VOCABULARY_BITS)
        np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        return pa.table({"address": [address], "shortest": pa.array([phrases.shortest], pa.int32()), "bits": pa.array([bits.view(np.int64)], pa.list_(pa.int64()))})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    made = store.written(dealt.groupBy("block").applyInArrow(prepare, "address string, shortest int, bits array<long>"), "phrase-blocks")
    named = made.filter("shortest > 0").select("address", "shortest").collect()
    words = made.select(F.posexplode("bits").alias("at", "word")).filter("word <> 0").groupBy("at").agg(F.bit_or("word").alias("word")).collect()
    vocabulary = np.zeros(VOCABULARY_BITS // 64, np.int64)
    vocabulary[[r["at"] for r in words]] = [r["word"] for r in words]
    return PhraseBlocks(sorted(r["address"] for r in named), vocabulary.view(np.uint64), min((r["shortest"] for r in named), default=0))


def find(texts: pa.Array, blocks: PhraseBlocks) -> tuple[Spans, np.ndarray, np.ndarray, list[str]]:
    """Build the index of one shard and search all blocks in it: the words, which are hit, and in the texts' order
    the texts with an item and those items (a pair may come twice if several blocks hold an id)."""
    found = spans(texts, ALNUM, fold=True)
    codes, distinct = found.codes()
    cover = np.zeros(len(found) + 1, np.int64)
    nothing = found, cover[:-1] > 0, np.zeros(0, np.int64), []
    if not blocks.shortest or not len(found):
        return nothing
    known = np.flatnonzero(blocks.may_hold(distinct))
    number = np.zeros(len(distinct), np.int64)
    number[known] = np.arange(1, len(known) + 1)
    symbols = number[codes]
    runs = Spans((symbols > 0).view(np.uint8), found.of, np.arange(256) > 0)
    size = runs.ends - runs.starts
    long = size >= blocks.shortest
    start, size = runs.starts[long], size[long]
    if not len(start):
        return nothing
    begin = np.cumsum(size + 1) - size - 1
    place = np.repeat(start - begin, size + 1) + np.arange(int((size + 1).sum()))
    text = symbols[np.minimum(place, len(symbols) - 1)]
    text[begin + size] = 0
    index = FMIndex(text, len(known))
    words, text_of = distinct.take(pa.array(known)), found.text_of()
    docs, items = [], []
    for phrases in blocks:
        # The shard's number of each of the block's words; windows with a word that the shard lacks aren't there.
        own = pc.index_in(phrases.words, value_set=words).fill_null(-1).to_numpy().astype(np.int64) + 1
        for windows, of, owners in phrases.by_length:
            table = own[windows]
            there = np.flatnonzero(table.all(axis=1))
            low, high = index.search(table[there])
            n = np.maximum(high - low, 0)
            some = np.flatnonzero(n)
            per = n[some]
            suffixes = np.repeat(low[some] - (np.cumsum(per) - per), per) + np.arange(per.sum())
            at = place[index.locate(suffixes)]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + windows.shape[1], -1)
            window = np.repeat(there[some], per)
            times = of[window + 1] - of[window]
            item = owners[np.repeat(of[window] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
            pair = np.unique(np.repeat(text_of[at], times) << 32 | item)
            docs.append(pair >> 32)
            items += [phrases.names[i] for i in (pair & 0xFFFFFFFF).tolist()]
    doc = np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    return found, np.cumsum(cover)[:-1] > 0, doc[order], [items[i] for i in order.tolist()]


_FOUND = "doc_id long, n_words long, spans array<struct<first:long,last:long,begin:long,end:long>>, items array<string>"


def search(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """A row for each row of `docs` (doc_id, text): doc_id, n_words, `spans` (merged: words first..last - 1,
    bytes begin..end - 1 of the UTF-8 text) and `items` (distinct item ids as strings, sorted).

    Null and empty texts have no words; rows that repeat come as often; an empty table stays empty, and
    with no items nothing is found. Further columns are left out.
    """
    blocks = phrase_blocks(benchmark, width, block_bytes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            found, hit, doc, item = find(batch.column("text"), blocks)
            runs = Spans(hit.view(np.uint8), found.of, np.arange(256) > 0)
            text = runs.text_of()
            base = found.offsets[:-1][text]
            fields = [runs.starts - found.of[:-1][text], runs.ends - found.of[:-1][text], found.starts[runs.starts] - base, found.ends[runs.ends - 1] - base]
            each = pa.StructArray.from_arrays([pa.array(f) for f in fields], ["first", "last", "begin", "end"])
            spans_ = pa.ListArray.from_arrays(pa.array(runs.of, pa.int32()), each)
            items = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32()), pa.array(item, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.counts()), spans_, items], ["doc_id", "n_words", "spans", "items"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(work), _FOUND).withColumn("items", F.array_sort(F.array_distinct("items")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of `docs`, all columns, that hold no window of any test item.

    Null and empty texts stay, as do rows that repeat; an empty table stays empty.
    """
    blocks = phrase_blocks(benchmark, width, block_bytes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            _, _, doc, _ = find(batch.column("text"), blocks)
            clean = np.ones(batch.num_rows, bool)
            clean[doc] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(tidied(work), docs.schema)


def without_spans(texts: pa.Array, blocks: PhraseBlocks) -> tuple[pa.Array, np.ndarray]:
    """The texts with their merged spans cut out, and which were cut. What a cut joins is searched again, until
    no text holds a window; a gap between two words stays where a span was."""
    values, cut = texts.to_pylist(), np.zeros(len(texts), bool)
    left = np.arange(len(texts))
    while len(left):
        found, hit, doc, _ = find(pa.array([values[i] for i in left], pa.string()), blocks)
        doc = np.unique(doc)
        runs = Spans(hit.view(np.uint8), found.of, np.arange(256) > 0)
        for d in doc.tolist():
            base = found.offsets[d]
            raw, at, parts = values[left[d]].encode(), 0, []
            for r in range(runs.of[d], runs.of[d + 1]):
                parts.append(raw[at : found.starts[runs.starts[r]] - base])
                at = found.ends[runs.ends[r] - 1] - base
            values[left[d]] = b"".join([*parts, raw[at:]]).decode()
        left = left[doc]
        cut[left] = True
    return pa.array(values, texts.type), cut


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of `docs`, all columns, with every merged span cut out of `text`. Texts without one are as they were."""
    blocks = phrase_blocks(benchmark, width, block_bytes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            k = batch.schema.get_field_index("text")
            text, _ = without_spans(batch.column(k), blocks)
            yield batch.set_column(k, batch.schema.field(k), text)

    return docs.mapInArrow(tidied(work), docs.schema)
