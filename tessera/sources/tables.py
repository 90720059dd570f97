"""Tables as DataFrames, and snapshots as the way to publish a changed one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import snapshots


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, name: str, partition: str | None = None, bounds: tuple[int, int, int] | None = None, **options) -> DataFrame:
    """A table of a relational database, read in parallel ranges of a numeric column if one is named."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if partition and bounds:
        low, high, n = bounds
        reader = reader.options(partitionColumn=partition, lowerBound=low, upperBound=high, numPartitions=n)
    return reader.load()


def query(spark: SparkSession, sql: str, **args) -> DataFrame:
    """SQL with named parameters."""
    return spark.sql(sql, args=args)


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def publish(df: DataFrame, base: str) -> int:
    """Replace a table by `df`, whatever it holds, and return the version; readers see the old or the new one, never half.

    What is made from the table's own rows must go through `snapshots.update` instead, which loses no other writer's change."""
    return snapshots.update(df.sparkSession, base, lambda _: df)


def published(spark: SparkSession, base: str) -> DataFrame:
    """The newest snapshot."""
    held = snapshots.read(spark, base)
    if held is None:
        raise FileNotFoundError(f"nothing is published at {base}")
    return held


def append_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows and those new ones whose key wasn't there (insert-ignore)."""
    return old.unionByName(new.dropDuplicates([key]).join(old, key, "left_anti").select(*old.columns))
