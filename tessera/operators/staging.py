"""Cutting lineage: tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KNOWN: set[str] = set()


def base_dir(spark: SparkSession) -> str:
    """This application's part of the folder of `spark.checkpoint.dir`; it goes when Python ends. Where the setting
    is missing a temporary folder serves a single machine (`local[...]`); on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.gettempdir()}/tessera-shared"
    path = f"{named.rstrip('/')}/tessera/staged-{spark.sparkContext.applicationId}"
    if path not in _KNOWN:
        _KNOWN.add(path)
        atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Drop the staged tables, once no result that reads them is needed."""
    _drop(spark, base_dir(spark))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: the plan starts anew there."""
    spark = df.sparkSession
    path = f"{base_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
