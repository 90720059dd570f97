"""Rank fusion and the choice of one pointer for each conversation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.staging import staged


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Number all rows from 1 in a total order without bringing them to one task: rows are dealt by ranges of the
    order, numbered in their range, and shifted by the sizes of the ranges before (one row a range). The dealt
    rows are written, because ranges are sampled and a second run of the plan could cut them elsewhere."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = dealt.withColumn("_k", F.row_number().over(W.partitionBy("_range").orderBy(*order)))
    return inside.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_k")).drop("_range", "_before", "_k")


def numbered(df: DataFrame, score: Column, key: str = "id", depth: int | None = None, few: int = 20_000) -> DataFrame:
    """(key, score, rank): ranks from 1 by score descending, then key. With a depth, a bounded top-k, which one task
    can number; so can it a table of at most `few` rows, which are counted first. Ranks are the same either way."""
    rows = df.select(key, score.alias("score"))
    order = (F.desc("score"), F.asc(key))
    if depth is None and df.count() > few:
        return global_rank(rows.filter("score is not null"), *order)
    # Nulls come last, so they can go after the limit; a filter below it would work out each score twice.
    top = rows.orderBy(*order).limit(depth or few).filter("score is not null")
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def rrf(lists: list[DataFrame], key: str = "id", k: int = 60) -> DataFrame:
    """(key, rrf, list_no, list_rank): sums of 1 / (k + rank) over ranked lists (key, rank); list_no and
    list_rank say where the key comes first, which settles ties as insertion order would."""
    parts = [d.select(key, F.lit(i).alias("list_no"), F.col("rank")) for i, d in enumerate(lists)]
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf"),
        F.min("list_no").alias("list_no"),
        F.min_by("rank", F.struct("list_no", "rank")).alias("list_rank"),
    )


def fused_rank(fused: DataFrame, key: str = "id") -> DataFrame:
    """Number fused keys from 1. The lists that are fused are the candidates of one query."""
    order = [F.desc(F.round("rrf", 12)), "list_no", "list_rank", key]
    return fused.withColumn("fused_rank", F.row_number().over(W.orderBy(*order)))


def collapse(fused: DataFrame, group: str, granularity: Column, key: str = "id", limit: int = 8) -> DataFrame:
    """(group, key, score, place): one pointer a group, its best window if it has one, else its best row, with the score of
    its best row, in the order of the groups' best rows. Grouped minima and a top-k; nothing is ranked as a whole."""
    at = F.struct((-F.round("rrf", 12)).alias("s"), "list_no", "list_rank", F.col(key).alias("k"))
    best = fused.groupBy(group).agg(F.min_by(key, F.struct((granularity != "window").cast("int"), at)).alias(key), F.max("rrf").alias("score"), F.min(at).alias("_at"))
    return best.orderBy("_at").limit(limit).withColumn("place", F.row_number().over(W.orderBy("_at"))).drop("_at")
