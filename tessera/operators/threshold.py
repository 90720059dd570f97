"""The first groups of a rank fusion without ranking all rows: the threshold algorithm.

Every list is read to a depth only. What a row scores by the lists it was met in is known, and a list where it wasn't met adds
at most 1 / (k + depth + 1). Rows that could still be among the first get their missing ranks by one count of the rows before
them. When the last group wanted beats what any row not met could have, the answer is exact; else the lists are read
deeper. The driver holds the tops of the lists: `depth` rows each, which depends on the query alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: Sums are compared by this many places, as the fused order does; bounds allow for less.
PLACES, SLACK = 12, 1e-10


@dataclass
class Row:
    """A row that was met: its score and, if known, its rank in each list (None where it has no score)."""

    key: object
    group: object
    window: bool
    scores: list[float | None]
    ranks: list[int | None]

    def unknown(self) -> list[int]:
        return [i for i, s in enumerate(self.scores) if s is not None and self.ranks[i] is None]

    def least(self, k: int) -> float:
        return sum(1.0 / (k + r) for r in self.ranks if r is not None)

    def most(self, k: int, depth: int) -> float:
        return self.least(k) + len(self.unknown()) / (k + depth + 1)

    def order(self, k: int) -> tuple:
        first = next(i for i, s in enumerate(self.scores) if s is not None)
        return (-round(self.least(k), PLACES), first, self.ranks[first], self.key)


def _tops(scored: DataFrame, n: int, depth: int) -> tuple[dict[object, Row], list[bool]]:
    """The rows in the tops of the lists, and which lists end there."""
    met: dict[object, Row] = {}
    ended = []
    for i in range(n):
        # Nulls come last, so they can go after the limit.
        top = scored.orderBy(F.desc(f"s{i}"), "key").limit(depth).filter(f"s{i} is not null").collect()
        ended.append(len(top) < depth)
        for rank, r in enumerate(top, start=1):
            row = met.setdefault(r["key"], Row(r["key"], r["group"], r["window"], [r[f"s{j}"] for j in range(n)], [None] * n))
            row.ranks[i] = rank
    return met, ended


def _count_before(scored: DataFrame, rows: list[Row]) -> None:
    """Fill in the missing ranks of some rows. For each list its rows at stake are sorted; a row of the table is before a
    tail of them, and one grouped count says how long these tails are."""
    parts, at = [], {}
    for i in range(len(rows[0].scores) if rows else 0):
        own = sorted((r for r in rows if i in r.unknown()), key=lambda r: (-r.scores[i], r.key))
        if not own:
            continue
        at[i] = own
        marks = F.array(*(F.struct(F.lit(float(r.scores[i])).alias("s"), F.lit(r.key).alias("k")) for r in own))
        ahead = scored.filter(F.col(f"s{i}") >= float(own[-1].scores[i])).select("key", F.col(f"s{i}").alias("score"))
        behind = F.size(F.filter(marks, lambda m: (F.col("score") > m["s"]) | ((F.col("score") == m["s"]) & (F.col("key") < m["k"]))))
        parts.append(ahead.select(F.lit(i).alias("list"), behind.alias("behind")))
    if not parts:
        return
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    counts = {(r["list"], r["behind"]): r["n"] for r in both.groupBy("list", "behind").agg(F.count("*").alias("n")).collect()}
    for i, own in at.items():
        before, m = 0, len(own)
        # The first of the sorted rows is behind those that have all m of them behind, and so on.
        for j, row in enumerate(own):
            before += counts.get((i, m - j), 0)
            row.ranks[i] = before + 1


def first_groups(items: DataFrame, scores: list[Column], group: str, granularity: Column, key: str = "id", limit: int = 8, k: int = 60, depth: int = 1024, deepest: int = 1 << 16) -> DataFrame | None:
    """(group, key, score, place), as `fusion.collapse` of the fused lists gives it: the groups of the best fused rows, each with its
    best window (or its best row, if it has no window) and the score of its best row. A null score leaves a row out of a list.

    None if `deepest` rows of each list don't settle it (nearly all rows fused alike): rank the lists as a whole then.
    """
    spark, n = items.sparkSession, len(scores)
    named = [s.alias(f"s{i}") for i, s in enumerate(scores)]
    # Only what ranking needs, worked out once; a lost part is worked out again.
    scored = items.select(F.col(key).alias("key"), F.col(group).alias("group"), (granularity == "window").alias("window"), *named).persist()
    try:
        while depth <= deepest:
            found = _settled(scored, n, limit, k, depth)
            if found is not None:
                kinds = [StructField(group, items.schema[group].dataType), StructField(key, items.schema[key].dataType), StructField("score", DoubleType()), StructField("place", IntegerType())]
                return spark.createDataFrame([(g, at, s, p) for p, (g, at, s) in enumerate(found, start=1)], StructType(kinds))
            depth *= 4
    finally:
        scored.unpersist()
    return None


def _settled(scored: DataFrame, n: int, limit: int, k: int, depth: int) -> list[tuple] | None:
    met, ended = _tops(scored, n, depth)
    unseen = sum(1.0 / (k + depth + 1) for e in ended if not e)
    for row in met.values():
        for i in range(n):
            if ended[i] and row.ranks[i] is None:
                row.scores[i] = None  # the whole list was read
    best: dict[object, float] = {}
    for row in met.values():
        best[row.group] = max(best.get(row.group, 0.0), row.least(k))
    least = sorted(best.values(), reverse=True)[limit - 1] if len(best) >= limit else 0.0
    open_ = [r for r in met.values() if r.most(k, depth) >= least - SLACK]
    _count_before(scored, open_)
    ranked = sorted((r for r in open_ if not r.unknown()), key=lambda r: r.order(k))
    firsts: dict[object, Row] = {}
    for row in ranked:
        if len(firsts) < limit:
            firsts.setdefault(row.group, row)
    if unseen and (len(firsts) < limit or list(firsts.values())[-1].least(k) <= unseen + SLACK):
        return None
    # A group whose best row is no window may have a window among those that were met.
    others = {g for g, r in firsts.items() if not r.window}
    windows = [r for r in met.values() if r.window and r.group in others]
    _count_before(scored, [r for r in windows if r.unknown()])
    pointers = dict(firsts)
    for g in others:
        own = min((r for r in windows if r.group == g), key=lambda r: r.order(k), default=None)
        if own is not None and (not unseen or own.least(k) > unseen + SLACK):
            pointers[g] = own
        elif unseen and scored.filter((F.col("group") == F.lit(g)) & F.col("window") & F.coalesce(*(F.col(f"s{i}") for i in range(n))).isNotNull()).limit(1).count():
            return None  # a window that wasn't met may be the one
    return [(g, pointers[g].key, r.least(k)) for g, r in firsts.items()]
