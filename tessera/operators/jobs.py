"""Batch-job audit: runs, items and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINISHED = ("qc_passed", "completed")


def run_summary(items: DataFrame) -> DataFrame:
    """Count and mean score (null scores ignored) of each status, and a row `total` of all."""
    g = items.withColumn("score", F.col("score").cast("double")).rollup("status").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"), F.grouping("status").alias("_all"))
    return g.select(F.when(F.col("_all") == 1, "total").otherwise(F.col("status")).alias("status"), "n", "avg_score")


def fold_items(log: DataFrame, key: str = "item", fields: tuple[str, ...] = ("status", "score", "error_text")) -> DataFrame:
    """Each item's state after an append log (seq, bump): a field keeps its last value that isn't null; bumps are attempts."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields]
    return log.groupBy(key).agg(*last, F.sum(F.col("bump").cast("int")).alias("attempt"))


def is_fresh(status: Column, stored_hash: Column, now_hash: Column) -> Column:
    """An item can be skipped: it is finished and its text is the one it was finished for."""
    return F.coalesce(status.isin(*FINISHED) & (stored_hash == now_hash), F.lit(False))


def embedding_cost(chunks: Column, tokens_per_chunk: int = 150, dollars_per_million: float = 0.02) -> Column:
    return chunks * tokens_per_chunk / 1_000_000 * dollars_per_million
