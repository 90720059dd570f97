"""Binary forms of transcripts and vectors, written and read in Arrow batches; what can't be read is null, not an error."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, FloatType, StringType, StructField, StructType

#: A stored conversation, and what its missing fields are.
DOCUMENT = (
    "schema int, source_host string, source_ref string, title string, redaction_count int, "
    "turns array<struct<seq: int, role: string, blocks: array<struct<type: string, text: string, tool_name: string, tool_input: string>>>>, title_hint string"
)
VECTOR = "<f4"
LEVEL = 6


def _zipped(texts: pa.Array) -> Iterator[bytes | None]:
    """Each text deflated; of the texts only one at a time is an object of Python's."""
    for text in texts.cast(pa.binary()):
        yield zlib.compress(text.as_buffer(), LEVEL) if text.is_valid else None


def _texts(bodies: pa.Array) -> Iterator[str | None]:
    for body in bodies:
        try:
            yield zlib.decompress(body.as_buffer()).decode() if body.is_valid else None
        except (zlib.error, UnicodeDecodeError):
            yield None


def _release() -> None:
    """Give unused memory back: a worker serves many tasks, and would keep its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def _packed(vector: np.ndarray | None) -> bytes | None:
    return None if vector is None or not len(vector) else np.asarray(vector, VECTOR).tobytes()


def _each(fn: Callable, kind: DataType, column: Column) -> Column:
    def work(values: pd.Series) -> pd.Series:
        return values.map(fn)

    return F.pandas_udf(work, kind)(column)


def deflate(text: Column) -> Column:
    """A text's UTF-8 as a zlib stream; null stays null."""

    @F.arrow_udf(BinaryType())
    def work(texts: pa.Array) -> pa.Array:
        return pa.array(_zipped(texts), pa.binary())

    return work(text)


def inflate(body: Column) -> Column:
    """The text of a zlib stream; null if it is cut, broken or no UTF-8. All texts of a batch come at once: see `inflated`."""

    @F.arrow_udf(StringType())
    def work(bodies: pa.Array) -> pa.Array:
        return pa.array(_texts(bodies), pa.string())

    return work(body)


def _parts(batches: Iterator[pa.RecordBatch], body: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    def part(batch: pa.RecordBatch, at: int, texts: list[str | None]) -> pa.RecordBatch:
        own = batch.slice(at, len(texts))
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == body else own.column(n) for n in own.schema.names], own.schema.names)

    for batch in batches:
        at, held, texts = 0, 0, []
        for text in _texts(batch.column(body)):
            texts.append(text)
            held += len(text or "")
            if held >= most_bytes:
                yield part(batch, at, texts)
                at, held, texts = at + len(texts), 0, []
        if texts:
            yield part(batch, at, texts)
    _release()


def inflated(rows: DataFrame, body: str, most_bytes: int = 4 << 20) -> DataFrame:
    """The rows with the body's text (as `inflate` has it) in the body's place. However large the texts of a batch are, they go on as
    soon as about `most_bytes` are inflated (one text at least)."""
    schema = StructType([StructField(f.name, StringType()) if f.name == body else f for f in rows.schema.fields])

    return rows.mapInArrow(lambda batches: _parts(batches, body, most_bytes), schema)


def pack_vector(vector: Column) -> Column:
    """A vector's components as little-endian 32-bit floats; null and empty ones are null."""
    return _each(_packed, BinaryType(), vector)


def unpack_vector(blob: Column, width: int | None = None) -> Column:
    """The components; null if the bytes are empty, are no whole number of floats, or (with a width) are of another width."""
    n = F.octet_length(blob)
    whole = (n > 0) & (n % 4 == 0) & ((n == 4 * width) if width else F.lit(True))
    # Python sees sound bytes only; a branch of `when` would not keep others from it.
    floats = _each(lambda b: np.frombuffer(b, VECTOR), ArrayType(FloatType()), F.when(whole, blob).otherwise(F.lit(b"")))
    return F.when(whole, floats)


def document(turns: DataFrame, *keys: str) -> DataFrame:
    """(keys, doc): each conversation's turns (seq, role, blocks) and its other fields (source_host, source_ref, title,
    redaction_count, title_hint; null where there is no such column) as one nested document."""
    own = {c: (F.first(c) if c in turns.columns else F.lit(None)) for c in ("source_host", "source_ref", "title", "title_hint")}
    count = F.sum("redaction_count").cast("int") if "redaction_count" in turns.columns else F.lit(0)
    fields = turns.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "role", "blocks"))).alias("turns"), *(c.cast("string").alias(f"_{n}") for n, c in own.items()), count.alias("redaction_count"))
    doc = F.struct(F.lit(1).alias("schema"), *(F.col(f"_{n}").alias(n) for n in ("source_host", "source_ref", "title")), "redaction_count", "turns", F.col("_title_hint").alias("title_hint"))
    return fields.select(*keys, doc.alias("doc"))


def body_of(doc: Column) -> Column:
    """A document's stored body: compact JSON without null fields, deflated."""
    return deflate(F.to_json(doc))


def document_of(body: Column) -> Column:
    """The document of a stored body; null if it can't be read. Missing hosts are `unknown`, missing references empty,
    missing turns none, a missing count 0."""
    return _document_of_text(inflate(body))


def with_documents(archive: DataFrame, body: str = "body") -> DataFrame:
    """The rows with `doc`, the document of each body (as `document_of` has it), in the body's place."""
    others = [c for c in archive.columns if c != body]
    return inflated(archive, body).select(*others, _document_of_text(F.col(body)).alias("doc"))


def _document_of_text(text: Column) -> Column:
    read = F.from_json(text, DOCUMENT)
    fills = {"source_host": F.lit("unknown"), "source_ref": F.lit(""), "redaction_count": F.lit(0)}
    names = [x.split(" ", 1)[0] for x in ("schema", "source_host", "source_ref", "title", "redaction_count", "turns", "title_hint")]
    fields = [F.coalesce(read[n], fills[n]).alias(n) if n in fills else read[n].alias(n) for n in names]
    sound = read.isNotNull() & F.coalesce(*(read[n].cast("string") for n in names)).isNotNull()
    return F.when(sound, F.struct(*fields))


def load_transcript(archive: DataFrame, transcript_id: str | int | None = None, source_ref: str | None = None, workspace_key: str | None = None) -> DataFrame:
    """(transcript_id, doc) of one archived conversation, or no row: by its id, else by its source, else the newest of a
    workspace. Only that row's body is inflated. Of several rows the one captured last counts (then the greatest id)."""
    for column, value in (("transcript_id", transcript_id), ("source_ref", source_ref), ("workspace_key", workspace_key)):
        if value:
            rows = archive.filter(F.col(column) == value)
            break
    else:
        raise ValueError("one of transcript_id, source_ref and workspace_key is needed")
    newest = rows.select("transcript_id", "body", "captured_at").orderBy(F.desc_nulls_last("captured_at"), F.desc("transcript_id")).limit(1)
    return newest.select("transcript_id", document_of(F.col("body")).alias("doc"))


def newest_transcripts(archive: DataFrame) -> DataFrame:
    """(workspace_key, transcript_id, doc): the same for every workspace at once; bodies are inflated after the choice."""
    best = archive.groupBy("workspace_key").agg(F.max_by(F.struct("transcript_id", "body"), F.struct("captured_at", "transcript_id")).alias("b"))
    return with_documents(best.select("workspace_key", "b.transcript_id", "b.body"))
