"""Real files in the shared folder, written and read by tasks.

Each attempt of a task writes files under names of its own and returns rows that name them; these
rows are stored by Spark's committed writer. So a file counts only if the table of rows names it,
and what a lost attempt left behind is never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, path: str) -> str:
    """Make a folder and return its full address, which tasks on any machine can open."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(where)
    return store.makeQualified(where).toString()


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, as Hadoop writes it, and the path there."""
    scheme, _, rest = address.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else address)


def new_name(folder: str, stem: str, ending: str) -> str:
    """A name that no other attempt uses."""
    return f"{folder}/{stem}-{uuid.uuid4().hex[:16]}{ending}"


def write(address: str, parts: list[bytes]) -> int:
    """Write a whole file; its size."""
    where, path = opened(address)
    with where.open_output_stream(path, compression=None) as out:
        for p in parts:
            out.write(p)
    return sum(map(len, parts))


def read(address: str) -> bytes:
    where, path = opened(address)
    with where.open_input_stream(path, compression=None) as f:
        return f.read()
