"""Connected components of an undirected graph, by alternating large-star and small-star steps.

Every step is a grouped minimum (summed before its shuffle) and an equi-join, so hubs need no
task of their own; each step's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import store


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of each component, for all nodes that have an edge.

    `edges` has columns u and v (long, no nulls); loops and repeats are ignored.
    """
    spark = edges.sparkSession
    path = store.new_path(spark, "star")
    now, seen = store.written_to(_small_star(edges), path), None
    for _ in range(most_rounds):
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if sums == seen or not sums["n"]:
            break
        seen = sums
        # Nothing but the next round reads a round's edges.
        last, path = path, store.new_path(spark, "star")
        now = store.written_to(_small_star(_large_star(now)), path)
        store.drop(spark, last)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
