"""WARC archives: writing, gzip normalisation and reading back by a sidecar index.

An archive that was gzipped as one stream can only be read from its start. The normaliser
inflates the whole stream once, rewrites every record as a gzip member of its own, and writes
a sidecar index of the members' offsets, so one record is read without the others.

Archives are files (`*.warc.gz`) in a folder that all machines share, and the index is a file of
JSON lines beside each (`*.warc.gz.index`: record, type, target, offset, length), so other tools
read both. A Parquet table in the same folder names the files that count; it is stored by Spark's
committed writer, so a lost executor repeats its task under new names. The normaliser takes any
table of archive addresses.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import files, store
from tessera.llm.textarrow import tidied

ARCHIVE = "archive string, records long, bytes long"
INDEXED = "archive string, index string, records long, bytes long"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One response record, or a revisit record without the payload but with its digest and length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names), block and end of the record at `at`; ValueError if there is none."""
    cut = raw.find(b"\r\n\r\n", at)
    if cut < 0 or raw[at : at + 5] != b"WARC/":
        raise ValueError(f"no WARC record at byte {at}")
    lines = raw[at:cut].decode("utf-8", "replace").split("\r\n")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    begin, size = cut + 4, int(head["content-length"])
    if begin + size + 4 > len(raw):
        raise ValueError(f"cut WARC record at byte {at}")
    return head, raw[begin : begin + size], begin + size + 4


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip file, of one member or several, as it comes in; ValueError if it is cut."""
    z = None
    for rest in chunks:
        while rest:
            z = z or zlib.decompressobj(31)
            yield z.decompress(rest)
            rest = z.unused_data
            if z.eof:
                z = None
    if z is not None:
        raise ValueError("cut gzip stream")


def inflate(content: bytes) -> bytes:
    """A whole gzip file, of one member or several."""
    return b"".join(inflated(iter([content])))


def records_of(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and raw bytes of each record of a gzip file, read once from its start and held one by one."""
    held, need = bytearray(), 0
    for part in inflated(chunks):
        held += part
        while len(held) >= max(need, 1):
            cut = held.find(b"\r\n\r\n")
            if cut < 0:
                break
            size = re.search(rb"\r\ncontent-length:\s*(\d+)", held[:cut], re.IGNORECASE)
            need = cut + 8 + int(size[1]) if size else len(held)
            if len(held) < need:
                break
            head, _, end = parse_record(bytes(held[:need]))
            yield head, bytes(held[:end])
            del held[:end]
            need = 0
    if held.strip():
        parse_record(bytes(held))  # says what is wrong with it


def _gzip(raw: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def with_originals(pages: DataFrame, least_bytes: int = 0, broadcast_rows: int = 100_000) -> DataFrame:
    """page_id, url, payload of every page (null html: empty) and `refers_to`: the smallest page_id of
    an equal payload, or null for that page itself, for payloads under `least_bytes` and for pages
    of a payload that no page with an id has. Rows that repeat the smallest id are all responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("size", F.octet_length("payload")).withColumn("sha", F.sha2("payload", 256))
    # Only groups of two pages or more, so the joined side is short; a hot payload is one row of it.
    firsts = keyed.filter(F.col("size") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("sha", "least")
    refs = keyed.filter(F.col("size") >= least_bytes).select("page_id", "sha").join(firsts, "sha").filter("page_id is null or page_id <> least").select(F.col("page_id").alias("key"), F.col("sha").alias("key_sha"), F.col("least").alias("refers_to")).distinct()
    # A short list of revisits goes to the pages; beyond the bound both sides are shuffled.
    refs = store.written(refs.filter("refers_to is not null"), "revisits")
    if refs.count() <= broadcast_rows:
        refs = F.broadcast(refs)
    return keyed.join(refs, F.col("page_id").eqNullSafe(F.col("key")) & (F.col("sha") == F.col("key_sha")), "left").select("page_id", "url", "payload", "refers_to")


def write_archives(pages: DataFrame, path: str, bytes_per_archive: int = 16 << 20) -> DataFrame:
    """Write pages (page_id, url, payload, refers_to) as archives under `path`, each one gzip stream of about
    `bytes_per_archive` records' bytes, and return the table of them."""
    spark = pages.sparkSession
    folder = files.new_folder(spark, f"{path}/archives")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, size, count, parts, z = TaskContext.get().partitionId(), 0, 0, 0, [], None

        def closed() -> pa.RecordBatch:
            parts.append(z.flush())
            address = files.new_name(folder, f"part-{part:06d}-{number:05d}", ".warc.gz")
            row = pa.RecordBatch.from_arrays([pa.array([address]), pa.array([count]), pa.array([files.write(address, parts)])], ["archive", "records", "bytes"])
            parts.clear()
            return row

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if z is None:
                    z, size, count = zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                raw = record_bytes(page_id, url, payload, refers_to)
                parts.append(z.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= bytes_per_archive:
                    yield closed()
                    number, z = number + 1, None
        if z is not None:
            yield closed()

    rows = pages.select("page_id", "url", "payload", "refers_to").mapInArrow(tidied(work), ARCHIVE)
    return store.written_to(rows, f"{path}/archives-table")


def _spread(table: DataFrame) -> DataFrame:
    """Rows that stand for whole files, a few a task: the table itself is small."""
    most = 8 * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(max(1, min(table.count(), most)))


def _chunks(address: str, size: int = 1 << 20) -> Iterator[bytes]:
    where, at = files.opened(address)
    with where.open_input_stream(at, compression=None) as f:
        while part := f.read(size):
            yield part


def normalise(archives: DataFrame, path: str) -> DataFrame:
    """Rewrite each archive (column `archive`: its address) under `path`: the same records, each a gzip member of
    its own, and a sidecar index of where each member is. Returns the table of the new archives and indexes.

    An archive passes through record by record; neither its content nor the new file is held whole.
    """
    folder = files.new_folder(archives.sparkSession, f"{path}/members")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                stem = source.rpartition("/")[2].split(".")[0]
                address = files.new_name(folder, stem, ".warc.gz")
                where, at = files.opened(address)
                offset, lines = 0, []
                with where.open_output_stream(at, compression=None) as out:
                    for head, raw in records_of(_chunks(source)):
                        member = _gzip(raw)
                        out.write(member)
                        lines.append(json.dumps({"record": head.get("warc-record-id", ""), "type": head.get("warc-type", ""), "target": head.get("warc-target-uri"), "offset": offset, "length": len(member)}))
                        offset += len(member)
                files.write(f"{address}.index", ["".join(f"{x}\n" for x in lines).encode()])
                yield pa.RecordBatch.from_arrays([pa.array([address]), pa.array([f"{address}.index"]), pa.array([len(lines)]), pa.array([offset])], ["archive", "index", "records", "bytes"])

    return store.written_to(_spread(archives.select("archive")).mapInArrow(tidied(work), INDEXED), f"{path}/members-table")


def _page(value: str) -> int | None:
    number = value.strip("<>").removeprefix(_ID)
    return int(number) if number else None


def record_at(archive: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record of a normalised archive, by its entry of the index alone."""
    where, at = files.opened(archive)
    with where.open_input_file(at) as f:
        return parse_record(inflate(f.read_at(length, offset)))[:2]


def read_pages(indexed: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record, member by member through the index."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def read(archive: str, index: str) -> Iterator[tuple]:
        where, at = files.opened(archive)
        with where.open_input_file(at) as f:
            for line in files.read(index).splitlines():
                entry = json.loads(line)
                head, block, _ = parse_record(inflate(f.read_at(entry["length"], entry["offset"])))
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "response" and (len(payload) != size or digest_of(payload) != digest):
                    raise ValueError(f"record {entry['record']} is damaged")
                refers = head.get("warc-refers-to")
                yield _page(head["warc-record-id"]), size, digest, head["warc-type"], _page(refers) if refers else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for archive, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist(), strict=True):
                columns = list(zip(*read(archive, index), strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _spread(indexed.select("archive", "index")).mapInArrow(tidied(work), schema)


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages as monolithic archives, normalise them, and read the records back by the index.

    Null html is an empty payload; a null url has no target; rows that repeat are records of their own.
    Pages without an id revisit the first page of their payload; an empty table has no archive.
    """
    path = store.new_path(pages.sparkSession, "warc")
    return read_pages(normalise(write_archives(with_originals(pages, least_bytes), path), path))
