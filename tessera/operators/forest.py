"""A forest in reading order: subtree sizes and pre-order places, by an Euler tour that is ranked in rounds that double."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.staging import staged

DOWN, UP = 0, 1


def _rooted(nodes: DataFrame, rounds: int) -> DataFrame:
    """(id, parent, root, depth): a parent that isn't there makes a root; on a loop, or below one, root and depth are null."""
    there = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("_there"))
    own = nodes.join(there, "parent", "left").select("id", F.when(F.col("_there"), F.col("parent")).alias("parent"))
    now = own.select("id", "parent", F.coalesce("parent", "id").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("parent").isNull().alias("done"))
    now = staged(now, "forest-roots")
    for _ in range(rounds):
        if not now.filter("not done").limit(1).count():
            break
        far = now.select(F.col("id").alias("root"), F.col("root").alias("_r"), F.col("depth").alias("_d"), F.col("done").alias("_done"))
        step = now.filter("not done").join(far, "root").select("id", "parent", F.col("_r").alias("root"), (F.col("depth") + F.col("_d")).alias("depth"), F.col("_done").alias("done"))
        now = staged(now.filter("done").unionByName(step), "forest-roots")
    return now.select("id", "parent", F.when(F.col("done"), F.col("root")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"))


def _tour(rooted: DataFrame, order: DataFrame) -> DataFrame:
    """(at, next, n): a tour's steps, down to each node (n = 1) and up from it (n = 0), and the step after each.

    Siblings are in order of `at`, then id. A node's children are sorted in one task, which can spill."""
    nodes = rooted.join(order, "id")
    beside = W.partitionBy("parent").orderBy("at", "id")
    kin = nodes.filter("parent is not null").select("id", "parent", F.lead("id").over(beside).alias("sibling"), (F.row_number().over(beside) == 1).alias("eldest"))
    eldest = kin.filter("eldest").select(F.col("parent").alias("id"), F.col("id").alias("child"))
    known = nodes.select("id", "parent").join(kin.select("id", "sibling"), "id", "left").join(eldest, "id", "left")
    step = lambda node, way: F.struct(F.col(node).alias("node"), F.lit(way).alias("way"))
    down = known.select(step("id", DOWN).alias("at"), F.when(F.col("child").isNotNull(), step("child", DOWN)).otherwise(step("id", UP)).alias("next"), F.lit(1).cast("long").alias("n"))
    up = known.select(
        step("id", UP).alias("at"), F.when(F.col("sibling").isNotNull(), step("sibling", DOWN)).when(F.col("parent").isNotNull(), step("parent", UP)).alias("next"), F.lit(0).cast("long").alias("n"),
    )
    return down.unionByName(up)


def _ranked(tour: DataFrame, rounds: int) -> DataFrame:
    """(at, n): how many downward steps there are from each step to the tour's end. Each round doubles how far a step sees."""
    now = staged(tour, "forest-tour")
    for _ in range(rounds):
        if not now.filter("next is not null").limit(1).count():
            return now.select("at", "n")
        far = now.select(F.col("at").alias("next"), F.col("next").alias("_next"), F.col("n").alias("_n"))
        step = now.filter("next is not null").join(far, "next").select("at", F.col("_next").alias("next"), (F.col("n") + F.col("_n")).alias("n"))
        now = staged(now.filter("next is null").unionByName(step), "forest-tour")
    raise RuntimeError(f"a tour is longer than 2^{rounds} steps")


def _paths(rooted: DataFrame, rounds: int, sep: str) -> DataFrame:
    """(id, path): the ids from the root down. Its size is that of all paths, so very deep chains make it large."""
    now = staged(rooted.filter("root is not null").select("id", F.col("parent").alias("up"), F.col("id").cast("string").alias("path")), "forest-paths")
    for _ in range(rounds):
        if not now.filter("up is not null").limit(1).count():
            break
        far = now.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        step = now.filter("up is not null").join(far, "up").select("id", F.col("_up").alias("up"), F.concat("_path", F.lit(sep), "path").alias("path"))
        now = staged(now.filter("up is null").unionByName(step), "forest-paths")
    return now.select("id", "path")


def preorder(nodes: DataFrame, key: str, parent: str, order: str, path: bool = True, sep: str = "/", rounds: int = 48) -> DataFrame:
    """(key, parent, root, depth, position, size, and path): each node's place in its tree in reading order (from 0; a node comes before
    its children, siblings by `order`, then key) and how many nodes its subtree has.

    A parent that isn't among the nodes is null: its children are roots. Nodes on a loop, or below one, have null in all of these but
    the parent. Keys are unique and not null. Every step is an equi-join over rows of a few columns, and their number grows with the
    logarithm of the longest tour, so neither a long chain nor a wide star needs a round a node.
    """
    named = nodes.select(F.col(key).alias("id"), F.col(parent).alias("parent"))
    rooted = staged(_rooted(named, rounds), "forest")
    sound = rooted.filter("root is not null")
    ranked = _ranked(_tour(sound, nodes.select(F.col(key).alias("id"), F.col(order).alias("at"))), rounds)
    places = ranked.groupBy(F.col("at.node").alias("id")).agg(F.sum(F.when(F.col("at.way") == DOWN, F.col("n"))).alias("_down"), F.sum(F.when(F.col("at.way") == UP, F.col("n"))).alias("_up"))
    tree = places.select(F.col("id").alias("root"), F.col("_down").alias("_whole"))
    out = rooted.join(places, "id", "left").join(tree, "root", "left")
    out = out.withColumn("position", F.col("_whole") - F.col("_down")).withColumn("size", F.col("_down") - F.col("_up"))
    columns = [F.col("id").alias(key), F.col("parent").alias(parent), "root", "depth", "position", "size"]
    if path:
        out, columns = out.join(_paths(rooted, rounds, sep), "id", "left"), [*columns, "path"]
    return out.select(*columns)
