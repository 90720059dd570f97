"""Packing by minimum bin slack.

Each document's ids are cut into full windows of `capacity` and one remainder. Remainders go
to cells (a hash of document, piece and row, about `pieces_per_cell` each, so that no cell grows
with the input); each cell is packed alone. A window starts with the longest remainder left.
A bitset of the sums that the multiset of the other lengths can reach, built length by
length, finds the sum closest to what is left; backtracking through the bitsets gives how
many pieces of each length make it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe, store
from tessera.llm.textarrow import slices, tidied

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """A row a piece of each whole text (null: empty, so the end id alone): full windows, then the remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(tokenizer)
        for batch in slices(batches, "text", 4 << 20):
            ids, offsets = encode(batch.column("text"), end_id)
            n = np.diff(offsets)
            per = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), per)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * capacity
            length = np.minimum(n[doc] - start, capacity)
            begin = offsets[doc] + start
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(bpe.crc32_of_slices(ids, begin, begin + length)), pa.array(n[doc])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(cut), PIECE)


def closest_subset(lengths: list[int], counts: list[int], room: int) -> list[int]:
    """How many pieces of each length (longest first) have the greatest sum up to `room`.

    Counts are taken in binary parts (1, 2, 4, ... and the rest); bit s of a part's bitset
    says that the parts up to it reach the sum s. The first part that reaches `room` ends the build.
    """
    mask, reached = (1 << (room + 1)) - 1, 1
    parts, before = [], []
    for k, (length, n) in enumerate(zip(lengths, counts, strict=True)):
        if length > room:
            continue
        n, size = min(n, room // length), 1
        while n:
            take = min(size, n)
            parts.append((k, take, take * length))
            before.append(reached)
            reached |= reached << (take * length) & mask
            n, size = n - take, 2 * size
        if reached >> room & 1:
            break
    used, left = [0] * len(lengths), reached.bit_length() - 1
    for (k, take, amount), had in zip(reversed(parts), reversed(before), strict=True):
        if not had >> left & 1:
            used[k] += take
            left -= amount
    return used


def fill_windows(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; pieces of one length are taken in the order given."""
    values, inverse, counts = np.unique(lengths, return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    next_of = np.cumsum(counts) - counts
    window, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left = {int(v): int(c) for v, c in zip(values[::-1], counts[::-1], strict=True)}
    where = {int(v): k for k, v in enumerate(values)}
    number = 0
    while left:
        at = 0

        def put(length: int, n: int) -> None:
            nonlocal at
            k = where[length]
            for _ in range(n):
                piece = order[next_of[k]]
                next_of[k] += 1
                window[piece], offset[piece] = number, at
                at += length
            left[length] -= n
            if not left[length]:
                del left[length]

        longest = next(iter(left))
        put(longest, 1)
        if room := capacity - longest:
            names = list(left)
            for length, n in zip(names, closest_subset(names, list(left.values()), room), strict=True):
                if n:
                    put(length, n)
        number += 1
    return window, offset


def pack(pieces: DataFrame, capacity: int = 4096, pieces_per_cell: int = 4096) -> DataFrame:
    """Add `sequence_id` and `offset` to pieces of 1 to `capacity` tokens; an empty table stays empty.

    A cell holds about `pieces_per_cell` pieces, and a partition many cells, of which a task holds one at
    a time. A piece's cell comes from its row and its place in the table, so rows that repeat spread too.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_cell(batches):
            cell = part.column("cell")[0].as_py()
            window, offset = fill_windows(part.column("length").to_numpy(), capacity)
            part = part.drop_columns(["cell"]).append_column("sequence_id", pa.array(cell * (1 << 32) + window)).append_column("offset", pa.array(offset))
            yield from part.to_batches()

    kept = store.written(pieces, "pieces")
    cells = max(1, -(-kept.count() // pieces_per_cell))
    cell = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(cells)).alias("cell")
    order = ["cell", "length", "doc_id", "start", "ids_crc32"]
    dealt = kept.select("*", cell).repartition("cell").sortWithinPartitions(*order)
    return dealt.mapInArrow(tidied(fill), PIECE + ", sequence_id long, offset long")


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by `cell`, a table a cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
        for b, e in zip(edges, edges[1:], strict=False):
            if b == e:
                continue
            if held and held[-1].column("cell")[0].as_py() != cells[b]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(b, e - b))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """Pack whole documents (doc_id, text; further columns are left out) into sequences of at most `capacity` ids."""
    return pack(cut_pieces(docs, tokenizer, end_id, capacity), capacity)
