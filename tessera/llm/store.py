"""Tables in the folder that driver and executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[str] = []
_KNOWN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`. Where it is unset, a temporary folder serves a single
    machine (`local[...]`); on a cluster that is an error, as no other machine would see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return f"file://{tempfile.gettempdir()}/tessera-shared"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when Python ends."""
    path = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"
    if path not in _KNOWN:
        _KNOWN.add(path)
        atexit.register(_clear_at_exit, spark, path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return "/".join([own_dir(spark), *_SCRATCH, f"{name}-{uuid.uuid4().hex}"])


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Drop this application's intermediate tables, once no result that reads them is needed."""
    drop(spark, own_dir(spark))


def _clear_at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        drop(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside are dropped at the end; write what is needed of the result before."""
    _SCRATCH.append(f"scratch-{uuid.uuid4().hex}")
    path = "/".join([own_dir(spark), *_SCRATCH])
    try:
        yield path
    finally:
        _SCRATCH.pop()
        drop(spark, path)


def written(df: DataFrame, name: str, per_file: int = 0) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back: the plan starts anew there. Of large rows a file should
    have few (`per_file`): Parquet's writer and its reader hold about as many at once."""
    return written_to(df, new_path(df.sparkSession, name), per_file)


def written_to(df: DataFrame, path: str, per_file: int = 0) -> DataFrame:
    df.write.option("maxRecordsPerFile", per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_sorted(df: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
    """As `written`, in buckets of the keys and sorted by them. Spark keeps buckets for named tables only, so the table is named while
    it is written and opened; its files are those of any other table of the shared folder.

    If `df` is partitioned by the keys in as many partitions, each task holds whole buckets and writes a file for each. Joins by the
    keys of two such tables with equally many buckets read them side by side."""
    spark, table = df.sparkSession, f"tessera_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", new_path(spark, name)).saveAsTable(table)
    held = spark.table(table)
    held.schema  # opened: the plan keeps the files and their buckets
    spark.sql(f"drop table {table}")
    return held


@contextmanager
def _setting(spark: SparkSession, name: str, value: str, default: str) -> Iterator[None]:
    before = spark.conf.get(name, default)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sorted_reads(spark: SparkSession) -> AbstractContextManager[None]:
    """Inside, buckets of one file each count as sorted, as `written_sorted` leaves them."""
    return _setting(spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true", "false")


def batches_of(spark: SparkSession, most: int) -> AbstractContextManager[None]:
    """Inside, Arrow batches that tasks hand to Python have about `most` bytes (one row at least)."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", f"{max(most, 1)}b", "64m")


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The result of `make()` as a table of its own; the intermediate tables behind it are dropped."""
    path = new_path(spark, name)
    with scratch(spark):
        return written_to(make(), path)
