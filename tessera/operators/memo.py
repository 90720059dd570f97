"""Memoised embedding: each distinct text is given to the model once, whatever run asks for it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators import batching
from tessera.sources import snapshots

CACHE = "key string, model string, dimensions int, text string, embedding array<float>"
#: Parts of the cache that are put together once there are so many.
MOST_PARTS = 16


def normalised(text: Column) -> Column:
    """A query as it is keyed: trimmed, runs of white space one blank."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def key_of(text: Column, model: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}\n0\n"), normalised(text)), 256)


def cached(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """All cached vectors."""
    version = snapshots.newest(spark, base) if version is None else version
    parts = snapshots.manifest(spark, base, version)["parts"] if version else []
    return spark.read.schema(CACHE).parquet(*parts) if parts else spark.createDataFrame([], CACHE)


def remember(new: DataFrame, base: str, tries: int = 20) -> int:
    """Add vectors whose key isn't there (one a key) and return how many. If another writer comes first, what it added is left out."""
    spark = new.sparkSession
    for _ in range(tries):
        version = snapshots.newest(spark, base)
        path = f"{base}/part-{uuid.uuid4().hex}"
        new.dropDuplicates(["key"]).join(cached(spark, base, version).select("key"), "key", "left_anti").write.parquet(path)
        added = spark.read.schema(CACHE).parquet(path)
        n = added.count()
        parts = [*(snapshots.manifest(spark, base, version)["parts"] if version else []), path]
        if not n:
            snapshots.drop(spark, path)
            return 0
        if len(parts) > MOST_PARTS:
            whole = f"{base}/part-{uuid.uuid4().hex}"
            spark.read.schema(CACHE).parquet(*parts).write.parquet(whole)
            parts = [whole]
        try:
            snapshots.commit_manifest(spark, base, version, {"parts": parts, "schema": json.dumps(StructType.fromDDL(CACHE).jsonValue())})
            return n
        except snapshots.Conflict:
            snapshots.drop(spark, path)
    raise snapshots.Conflict(base)


def embed(rows: DataFrame, base: str, model: str, fn: Callable[[list[str]], list[list[float]]], text: str = "text", **how) -> tuple[DataFrame, dict[str, int]]:
    """`rows` with `memo_key`, `hit` (the vector was there before) and `embedding`; and how many distinct texts were asked for, found,
    embedded and left without a vector (blank ones, and those of failed batches: they are asked for again next time).

    The cache at `base` is read and added to by all runs. Only distinct misses reach the function.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("memo_key", key_of(F.col(text), model))
    asked = keyed.select(F.col("memo_key").alias("key"), normalised(F.col(text)).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    before = cached(spark, base).select("key", "embedding")
    misses = asked.join(before.select("key"), "key", "left_anti")
    # Written where it is counted: the model is called once a text.
    path = f"{base}/asked-{uuid.uuid4().hex}"
    made = batching.embed(misses, "key", "text", fn, **how)
    misses.join(made, "key").select("key", F.lit(model).alias("model"), F.size("embedding").alias("dimensions"), "text", "embedding").write.parquet(path)
    fresh = spark.read.schema(CACHE).parquet(path)
    stats = {"asked": asked.count(), "missed": fresh.count(), "embedded": remember(fresh.filter("embedding is not null"), base)}
    stats["found"] = stats["asked"] - stats["missed"]
    after = before.withColumn("hit", F.lit(True)).unionByName(fresh.select("key", "embedding", F.lit(False).alias("hit")))
    out = keyed.join(after.select(F.col("key").alias("memo_key"), "hit", "embedding"), "memo_key", "left")
    return out.select(*rows.columns, "memo_key", "hit", "embedding"), stats


def embed_query(spark: SparkSession, base: str, model: str, fn: Callable[[list[str]], list[list[float]]], query: str) -> list[float] | None:
    """One query's vector, from the cache if it is there; None for a blank query or if the model fails, and then a search is lexical."""
    if not (query or "").strip():
        return None
    row = spark.sql("select 1").select(F.lit(query).alias("text"))
    return embed(row, base, model, fn)[0].first()["embedding"]
