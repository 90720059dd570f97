"""Token-ID / binary output: directly addressable codes (DAC).

Ids are split into chunks of a few bits, lowest first. Level k holds the k-th chunk of every
id that has one, and a bitmap that says which of them go on to level k + 1. A rank directory
over each bitmap turns a position of one level into one of the next, so any token is read
from its chunks without decoding a block.

A corpus is a folder of segment files (`segments/*.dac`, plain uncompressed images) in ascending
document order, each with the ids of a run of whole documents, and a Parquet table `index` with a
row a segment: its file, its documents and how many ids it holds. One token is read by a few
reads of some bytes each from its segment's file. The index names the files that count, and
Spark's committed writer stores it, so a lost executor repeats only its task.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, files, store
from tessera.llm.textarrow import slices, tidied

#: Fixed values of the format: magic, bits of each level's chunks, bits counted by one rank entry.
MAGIC = b"TDAC2\0\0\0"
LEVEL_BITS = (8, 8, 16)
RANK_BITS = 512


def dac_encode(ids: np.ndarray, doc_offsets: np.ndarray, doc_ids: np.ndarray, named: np.ndarray) -> bytes:
    """One segment's image: header, document table, then chunks, bitmap and rank directory of each level.

    `doc_offsets` has n + 1 entries; `named` says which documents have an id; an empty segment is fine.
    """
    rest = np.ascontiguousarray(ids, np.uint32)
    parts, heads = [], []
    for k, bits in enumerate(LEVEL_BITS):
        last = k == len(LEVEL_BITS) - 1
        chunks = (rest & np.uint32((1 << bits) - 1)).astype(np.uint8 if bits <= 8 else "<u2")
        on = np.zeros(len(rest), bool) if last else rest >> np.uint32(bits) > 0
        bitmap = np.packbits(on, bitorder="little")
        ranks = np.zeros(len(rest) // RANK_BITS + 1, "<u4")
        whole = np.add.reduceat(on, np.arange(0, len(on), RANK_BITS), dtype=np.int64) if len(on) else np.zeros(0, np.int64)
        ranks[1:] = np.cumsum(whole)[: len(ranks) - 1]
        parts += [chunks.tobytes(), bitmap.tobytes(), ranks.tobytes()]
        heads.append(len(rest))
        rest = rest[on] >> np.uint32(bits) if not last else rest
    docs = np.asarray(doc_ids, "<i8").tobytes() + np.packbits(named, bitorder="little").tobytes() + np.asarray(doc_offsets, "<i8").tobytes()
    return MAGIC + struct.pack("<QQ", len(doc_ids), len(ids)) + struct.pack(f"<{len(heads)}Q", *heads) + docs + b"".join(parts)


class DacReader:
    """Random access to a segment: `fetch(at, n)` gives n bytes of its file from place `at`.

    Only the header is read at once; a token takes a chunk, some bitmap bytes and a rank entry a level.
    """

    def __init__(self, fetch: Callable[[int, int], bytes]):
        self.fetch = fetch
        size = 24 + 8 * len(LEVEL_BITS)
        head = fetch(0, size)
        if head[:8] != MAGIC:
            raise ValueError("not a segment file")
        self.n_docs, self.n_tokens = struct.unpack_from("<QQ", head, 8)
        self.sizes = struct.unpack_from(f"<{len(LEVEL_BITS)}Q", head, 24)
        self.docs_at, at = size, size + 8 * self.n_docs + (self.n_docs + 7) // 8 + 8 * (self.n_docs + 1)
        self.levels = []  # where each level's chunks, bitmap and ranks begin
        for bits, n in zip(LEVEL_BITS, self.sizes, strict=True):
            bitmap = at + n * (1 if bits <= 8 else 2)
            ranks = bitmap + (n + 7) // 8
            self.levels.append((at, bitmap, ranks))
            at = ranks + 4 * (n // RANK_BITS + 1)

    @classmethod
    def of(cls, image: bytes) -> DacReader:
        view = memoryview(image)
        return cls(lambda at, n: view[at : at + n])

    @classmethod
    def open(cls, address: str) -> DacReader:
        """A segment's file, read by ranges."""
        where, path = files.opened(address)
        held = where.open_input_file(path)
        return cls(lambda at, n: held.read_at(n, at))

    def _array(self, kind: str, n: int, at: int) -> np.ndarray:
        return np.frombuffer(self.fetch(at, n * np.dtype(kind).itemsize), kind, n)

    def documents(self) -> tuple[pa.Array, np.ndarray]:
        """The documents' ids (null where one has none) and the n + 1 offsets of their tokens."""
        n = self.n_docs
        ids = self._array("<i8", n, self.docs_at)
        named = np.unpackbits(self._array("u1", (n + 7) // 8, self.docs_at + 8 * n), bitorder="little")[:n].astype(bool)
        return pa.array(ids, mask=~named), self._array("<i8", n + 1, self.docs_at + 8 * n + (n + 7) // 8)

    def token(self, i: int) -> int:
        """Token i of the segment."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for k, bits in enumerate(LEVEL_BITS):
            chunks, bitmap, _ = self.levels[k]
            kind = "u1" if bits <= 8 else "<u2"
            value |= int(self._array(kind, 1, chunks + i * np.dtype(kind).itemsize)[0]) << shift
            if not self._array("u1", 1, bitmap + (i >> 3))[0] >> (i & 7) & 1:
                break
            shift += bits
            i = self._rank(k, i)
        return value

    def tokens(self, begin: int, end: int) -> np.ndarray:
        """Ids begin..end - 1: each level's slice is found by rank, and its chunks are laid over the last level's."""
        return self._level(0, begin, end)

    def _rank(self, k: int, i: int) -> int:
        """How many of level k's first i chunks go on."""
        _, bitmap, ranks = self.levels[k]
        block = i // RANK_BITS
        first = block * RANK_BITS // 8
        near = self._array("u1", (i + 7) // 8 - first, bitmap + first)
        return int(self._array("<u4", 1, ranks + 4 * block)[0]) + int(np.unpackbits(near, bitorder="little")[: i - block * RANK_BITS].sum())

    def _level(self, k: int, begin: int, end: int) -> np.ndarray:
        chunks, bitmap, _ = self.levels[k]
        kind = "u1" if LEVEL_BITS[k] <= 8 else "<u2"
        value = self._array(kind, end - begin, chunks + begin * np.dtype(kind).itemsize).astype(np.uint32)
        if end > begin and k + 1 < len(LEVEL_BITS):
            byte = begin >> 3
            on = np.unpackbits(self._array("u1", ((end + 7) >> 3) - byte, bitmap + byte), bitorder="little")[begin - 8 * byte : end - 8 * byte].astype(bool)
            if on.any():
                value[on] |= self._level(k + 1, self._rank(k, begin), self._rank(k, end)) << np.uint32(LEVEL_BITS[k])
        return value


SEGMENT = "part int, at int, first_doc long, last_doc long, n_docs long, n_tokens long, file string, bytes long"


def write_corpus(docs: DataFrame, path: str, tokenizer: str, end_id: int, tokens_per_segment: int = 2 << 20, docs_per_part: int = 65_536) -> None:
    """Encode every whole text of `docs` (doc_id, text) and write segments in ascending doc_id order under `path`.

    Null texts are empty documents; rows with equal doc_id stay apart, by a hash of the text, then in any
    order; rows without a doc_id come first and have none in the files. An empty table writes no segment.
    Range partitions hold about `docs_per_part` documents, so their count follows the input; equal or
    missing ids are dealt by the text's hash too.
    """
    spark = docs.sparkSession
    folder = files.new_folder(spark, f"{path}/segments")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        encode_ = bpe.encoder(tokenizer)
        ids, counts, names, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal at, held
            n = np.concatenate(counts)
            name = pa.concat_arrays(names)
            offsets = np.concatenate([[0], np.cumsum(n)])
            image = dac_encode(np.concatenate(ids), offsets, name.fill_null(0).to_numpy(zero_copy_only=False), name.is_valid().to_numpy(zero_copy_only=False))
            address = files.new_name(folder, f"part-{part:07d}-{at:05d}", ".dac")
            size = files.write(address, [image])
            values = [pa.array([part], pa.int32()), pa.array([at], pa.int32()), name[:1], name[-1:], *(pa.array([v], pa.int64()) for v in (len(n), held)), pa.array([address]), pa.array([size], pa.int64())]
            ids.clear(), counts.clear(), names.clear()
            at, held = at + 1, 0
            return pa.RecordBatch.from_arrays(values, ["part", "at", "first_doc", "last_doc", "n_docs", "n_tokens", "file", "bytes"])

        for batch in slices(batches, "text", 4 << 20):
            got, offsets = encode_(batch.column("text"), end_id)
            ids.append(got)
            counts.append(np.diff(offsets))
            names.append(batch.column("doc_id"))
            held += len(got)
            if held >= tokens_per_segment:
                yield flush()
        if counts:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = max(rows.select("doc_id").count() // docs_per_part, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    rows.mapInArrow(tidied(encode), SEGMENT).write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Each segment's row, and the ids of all segments before it (`first_token`).

    One row a segment: two levels of sums, the upper over one row a range partition.
    """
    from pyspark.sql import Window as W

    rows = spark.read.schema(SEGMENT).parquet(f"{path}/index")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    parts = parts.select("part", (F.sum("part_tokens").over(W.orderBy("part")) - F.col("part_tokens")).alias("part_first"))
    inner = F.sum("n_tokens").over(W.partitionBy("part").orderBy("at")) - F.col("n_tokens")
    return rows.withColumn("inner", inner).join(parts, "part").withColumn("first_token", F.col("part_first") + F.col("inner")).drop("inner", "part_first")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: a row a document with `start`, `n_tokens` and `ids_crc32` of its ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address, first in zip(batch.column("file").to_pylist(), batch.column("first_token").to_pylist(), strict=True):
                seg = DacReader.of(files.read(address))
                ids, off = seg.documents()
                crcs = bpe.crc32_of_slices(seg.tokens(0, seg.n_tokens), off[:-1], off[1:])
                yield pa.RecordBatch.from_arrays([ids, pa.array(first + off[:-1]), pa.array(np.diff(off)), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    index = store.written(read_index(spark, path).select("file", "first_token"), "dac-places")
    # A segment a task or so: the index itself is a few small files.
    spread = index.repartition(max(1, min(index.count(), 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return spread.mapInArrow(tidied(decode), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(spark: SparkSession, path: str, position: int) -> int:
    """Token `position` of the whole corpus: its segment by the index, then a few short reads of that segment's file."""
    held = read_index(spark, path).filter((F.col("first_token") <= position) & (F.col("first_token") + F.col("n_tokens") > position)).first()
    if held is None:
        raise IndexError(position)
    return DacReader.open(held["file"]).token(position - held["first_token"])


def encode_corpus(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the corpus to the shared folder and return what its files hold of each document."""
    spark = docs.sparkSession
    write_corpus(docs, path := store.new_path(spark, "dac"), tokenizer, end_id)
    return read_documents(spark, path)
