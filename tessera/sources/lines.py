"""A data source of JSON-lines transcripts: files are read by byte ranges, so a large one is many tasks.

A line belongs to the range in which it begins; its byte offset is its place in the file, so lines of one file are in order by
(path, offset) whatever the ranges. The option `slug` leaves files of other checkouts out before any is opened; it is an option because
in Spark 4.1 a filter that a Python source takes over stays with the source, and the same DataFrame read without it lacks rows. A
file that can't be read gives one row with `error`, and the others are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "folder string, path string, modified timestamp, offset long, raw string, error string"
#: Bytes that are read at once.
CHUNK = 4 << 20


@dataclass
class Range(InputPartition):
    address: str
    modified: datetime | None
    start: int
    end: int


def _opened(address: str):
    from pyarrow import fs

    if "://" not in address:
        address = "file://" + address.removeprefix("file:")
    return fs.FileSystem.from_uri(address)


def _folder(path: str) -> str:
    parts = path.rsplit("/", 2)
    return parts[-2] if len(parts) > 1 else ""


class LineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.glob, self.split = options["path"], options.get("glob", "*.jsonl"), int(options.get("splitbytes", 64 << 20))
        self.slug = options.get("slug")

    def _wanted(self, path: str) -> bool:
        own = _folder(path)
        return self.slug is None or own == self.slug or own.endswith(f"-{self.slug}")

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        where, base = _opened(self.path)
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else "file://"
        out = []
        for info in sorted(where.get_file_info(fs.FileSelector(base, recursive=True)), key=lambda i: i.path):
            address = scheme + info.path
            if info.type == fs.FileType.File and fnmatch(info.base_name, self.glob) and self._wanted(address):
                out += [Range(address, info.mtime, at, min(at + self.split, info.size)) for at in range(0, info.size, self.split)]
        return out or [Range("", None, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.address:
            return
        try:
            yield from self._lines(part)
        except OSError as e:
            yield self._batch(part, [0], [None], f"{type(e).__name__}: {e}")

    def _lines(self, part: Range) -> Iterator[pa.RecordBatch]:
        where, path = _opened(part.address)
        with where.open_input_file(path) as f:
            size, at, rest = f.size(), part.start, b""
            if at:  # a line that begins before the range is the last range's
                at -= 1
                skipping = True
            else:
                skipping = False
            begin = at
            while begin < part.end and at < size:
                data = f.read_at(CHUNK, at)
                at += len(data)
                if skipping:
                    cut = data.find(b"\n")
                    if cut < 0:
                        begin = at
                        continue
                    skipping, begin, data = False, begin + cut + 1, data[cut + 1 :]
                lines = (rest + data).split(b"\n")
                rest = lines.pop() if at < size else b""
                offsets, texts = [], []
                for line in lines:
                    if begin >= part.end:
                        break
                    if line:
                        offsets.append(begin)
                        texts.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    begin += len(line) + 1
                if texts:
                    yield self._batch(part, offsets, texts)

    @staticmethod
    def _batch(part: Range, offsets: list[int], texts: list[str | None], error: str | None = None) -> pa.RecordBatch:
        n = len(offsets)
        modified = pa.array([part.modified or datetime.fromtimestamp(0, UTC)] * n, pa.timestamp("us", "UTC"))
        same = lambda v: pa.array([v] * n, pa.string())
        return pa.RecordBatch.from_arrays([same(_folder(part.address)), same(part.address), modified, pa.array(offsets, pa.int64()), pa.array(texts, pa.string()), same(error)], ["folder", "path", "modified", "offset", "raw", "error"])


class TranscriptLines(DataSource):
    """`spark.read.format("transcript_lines").option("splitBytes", n).load(folder)`; `glob` names the files (`*.jsonl`), `slug` the
    checkout whose folders are read (that name, or one that ends with it)."""

    @classmethod
    def name(cls) -> str:
        return "transcript_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LineReader:
        return LineReader({k.lower(): v for k, v in self.options.items()})


def lines(spark: SparkSession, path: str, glob: str = "*.jsonl", split_bytes: int = 64 << 20, slug: str | None = None) -> DataFrame:
    """(folder, path, modified, offset, raw, error) of all lines of the files below a folder; empty lines go."""
    spark.dataSource.register(TranscriptLines)
    reader = spark.read.format("transcript_lines").option("glob", glob).option("splitBytes", str(split_bytes))
    return (reader.option("slug", slug) if slug else reader).load(path)
