"""The threshold algorithm against ranks of all rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval, threshold

SCHEMA = "id string, conv_id long, granularity string, a double, b double"


def both(spark, rows, limit=3, **how):
    items = spark.createDataFrame(rows, SCHEMA).persist()
    scores = [F.col("a"), F.col("b")]
    want = retrieval.ranked_as_a_whole(items, scores, limit)
    got = threshold.first_groups(items, scores, "conv_id", F.col("granularity"), limit=limit, **how)
    plain = lambda df: [(r["conv_id"], r["id"], round(r["score"], 12), r["place"]) for r in sorted(df.collect(), key=lambda r: r["place"])]
    out = plain(want), None if got is None else plain(got)
    items.unpersist()
    return out


@pytest.mark.parametrize("seed", range(6))
def test_random_lists(spark, seed):
    """Few different scores, so nearly all ranks are ties; rows without a score; groups without windows."""
    rng = random.Random(seed)
    value = lambda n: None if rng.random() < 0.2 else rng.randint(0, n) / n
    rows = [(f"r{i:03d}", rng.randint(0, 12), rng.choice(["window", "session", "item"]), value(4), value(50)) for i in range(120)]
    for depth in (4, 16, 64):
        want, got = both(spark, rows, depth=depth)
        assert got == want


def test_opposite_lists(spark):
    """What is first in one list is last in the other, and the best sum is in the middle of both."""
    n = 200
    rows = [(f"r{i:03d}", i, "window", float(n - i), float(i)) for i in range(n)]
    want, got = both(spark, rows, depth=4)
    assert got == want
    rows = [(f"r{i:03d}", i, "window", float(n - i), None if i < 100 else 1.0) for i in range(n)]
    want, got = both(spark, rows, depth=8)
    assert got == want


def test_windows_far_down(spark):
    """A conversation's session is first, its windows are last in both lists."""
    rows = [(f"s{i}", i, "session", 100.0 - i, 100.0 - i) for i in range(5)] + [(f"w{i}{j}", i, "window", 1.0 - i / 10 - j / 100, 1.0) for i in range(5) for j in range(8)]
    rows += [(f"o{i:03d}", 100 + i, "window", 50.0 - i / 10, 50.0 - i / 10) for i in range(100)]
    want, got = both(spark, rows, depth=4)
    assert got == want and got[0][1].startswith("w")


def test_one_group_and_no_rows(spark):
    rows = [(f"r{i:03d}", 1, "window", float(i), None) for i in range(60)]
    want, got = both(spark, rows, depth=4)
    assert got == want and len(got) == 1
    assert both(spark, [("r", 1, "window", None, None)]) == ([], [])
    assert both(spark, []) == ([], [])


def test_too_deep_is_told(spark):
    rows = [(f"r{i:03d}", 1, "window", float(i), float(i)) for i in range(60)]
    assert both(spark, rows, depth=4, deepest=8)[1] is None


def test_no_range_exchange(spark):
    """The plans of a search count and sort tops only: nothing is dealt by ranges of all rows."""
    items = spark.createDataFrame([(f"r{i}", i, "window", float(i), float(-i)) for i in range(50)], SCHEMA)
    taken = []
    real = type(items).repartitionByRange
    type(items).repartitionByRange = lambda self, *a: taken.append(a) or real(self, *a)
    try:
        got = threshold.first_groups(items, [F.col("a"), F.col("b")], "conv_id", F.col("granularity"))
        assert got.count() == 8 and "rangepartitioning" not in got._jdf.queryExecution().toString() and not taken
    finally:
        type(items).repartitionByRange = real
