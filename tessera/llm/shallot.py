"""Centroid clustering of integer vectors by exact k-means with Shallot search.

Each vector keeps its nearest and its second-nearest centroid, an upper bound of the distance to the first and a
lower bound of the distance to the second. Where the bounds can't prove that the first is still the nearest, both
are measured again; the scan starts at the closer one and walks its neighbours in order of their distance to it. A
centroid c can only be among the two nearest if d(c, start) <= d(x, start) + d(x, second), so the scan stops there;
that ball shrinks as soon as a closer second is found. Squared distances of all survivors are compared as integers,
ties by the smaller number, so results don't depend on rounding: bounds are floats, kept a margin apart.

A round is one pass over the table of vectors and bounds, which is written to the shared folder; centroids (k * dims
integers) are all that the driver holds. Sums are added in tasks, then by Spark, as exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import store
from tessera.llm.textarrow import tidied

#: Bounds are widened by this share, far more than the rounding of a root of a 63-bit integer.
MARGIN = 1e-9
STATE = "vec_id long, v array<long>, a int, b int, upper double, lower double, distance long"
#: Longest part of a batch that is searched at once.
ROWS = 8192


def largest_component(dims: int) -> int:
    """Components are held within this size, so that a squared distance fits 62 bits."""
    return int((2**62 // max(dims, 1)) ** 0.5) // 2


def quantised(table: DataFrame, dims: int = 64, scale: float = 64.0, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of the components x of vectors with exactly `dims` components, none null or not finite.

    All else is left out: null vectors, other lengths. Rows that repeat stay, rows without an id too; further columns go.
    Components beyond `largest_component` are held there (no distance between such vectors would fit a long).
    """
    most = float(largest_component(dims))
    x = F.col(vector).cast("array<double>")
    kept = (F.size(x) == dims) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    held = F.transform(x, lambda e: F.floor(F.greatest(F.least(e * scale, F.lit(most)), F.lit(-most))))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(kept, held).alias("v")).filter("v is not null")


def first_centroids(vectors: DataFrame, k: int = 16, salt: str = "1") -> np.ndarray:
    """The vectors with the smallest sha256 of `<salt>:<vec_id>` (no id: nothing after the colon), in that order; equal ids by
    their components. Fewer than k vectors give fewer centroids."""
    key = F.sha2(F.concat_ws(":", F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r["v"] for r in vectors.withColumn("_key", key).orderBy("_key", "v").limit(k).select("v").collect()], np.int64)


class Search:
    """Nearest and second-nearest centroids; `pairs` counts the distances that were measured."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        k = len(centroids)
        d2 = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(-1)
        self.apart = np.sqrt(d2.astype(float))
        order = np.lexsort((np.broadcast_to(np.arange(k), (k, k)), self.apart), axis=1)
        # Each centroid's other centroids, nearest first.
        self.near = np.array([[j for j in row if j != i] for i, row in enumerate(order)], np.int64).reshape(k, max(k - 1, 0))
        self.pairs = 0

    def squared(self, x: np.ndarray, j: np.ndarray) -> np.ndarray:
        self.pairs += len(x)
        diff = x - self.c[j]
        return np.einsum("ij,ij->i", diff, diff)

    def assign(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """New a, b, upper, lower from those of the round before, whose bounds already allow for how far centroids moved.

        `b` is -1 where there is one centroid only.
        """
        a, b, upper, lower = a.copy(), b.copy(), upper.copy(), lower.copy()
        if len(self.c) == 1:
            upper[:] = self._root(self.squared(x, a), 1)
            lower[:] = np.inf
            return a, b, upper, lower
        open_ = np.flatnonzero(upper >= lower)
        if len(open_):  # first with an exact upper bound
            upper[open_] = self._root(self.squared(x[open_], a[open_]), 1)
            open_ = open_[upper[open_] >= lower[open_]]
        if len(open_):
            a[open_], b[open_], d1, d2 = self._scan(x[open_], a[open_], b[open_])
            upper[open_], lower[open_] = self._root(d1, 1), self._root(d2, -1)
        return a, b, upper, lower

    @staticmethod
    def _root(squared: np.ndarray, side: int) -> np.ndarray:
        return np.sqrt(squared.astype(float)) * (1 + side * MARGIN)

    def _scan(self, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        da, db = self.squared(x, a), self.squared(x, b)
        swap = (db < da) | ((db == da) & (b < a))
        first, second = np.where(swap, b, a), np.where(swap, a, b)
        d1, d2 = np.where(swap, db, da), np.where(swap, da, db)
        start, other = first.copy(), second.copy()  # both are measured already
        here = np.sqrt(d1.astype(float))
        radius = here + np.sqrt(d2.astype(float))
        rows = np.arange(len(x))
        for t in range(self.near.shape[1]):
            j = self.near[start[rows], t]
            inside = self.apart[start[rows], j] <= radius[rows] * (1 + MARGIN)
            rows, j = rows[inside], j[inside]  # neighbours only get farther
            if not len(rows):
                break
            new = j != other[rows]
            r, j = rows[new], j[new]
            d = self.squared(x[r], j)
            best = (d < d1[r]) | ((d == d1[r]) & (j < first[r]))
            closer = ~best & ((d < d2[r]) | ((d == d2[r]) & (j < second[r])))
            up, nx = r[best], r[closer]
            second[up], d2[up] = first[up], d1[up]
            first[up], d1[up] = j[best], d[best]
            second[nx], d2[nx] = j[closer], d[closer]
            radius[r] = here[r] + np.sqrt(d2[r].astype(float))
        return first, second, d1, d2


def moved(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return np.sqrt(((after - before) ** 2).sum(-1).astype(float)) * (1 + MARGIN)


def _round(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """The state after one more assignment; `before`: the centroids of the assignment that made the bounds."""
    k, dims = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        drift = None if before is None else moved(before, centroids)
        if drift is not None and k > 1:
            # How far any centroid but a vector's own may have come closer.
            top = np.argsort(-drift, kind="stable")[:2]
            others = np.where(np.arange(k) == top[0], drift[top[1]], drift[top[0]])
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                n = len(x)
                if drift is None:
                    a, b = np.zeros(n, np.int64), np.full(n, 1 if k > 1 else -1)
                    upper, lower = np.full(n, np.inf), np.zeros(n)
                else:
                    a, b = (part.column(c).to_numpy().astype(np.int64) for c in "ab")
                    upper = (part.column("upper").to_numpy() + drift[a]) * (1 + MARGIN)
                    lower = part.column("lower").to_numpy() - (others[a] if k > 1 else 0)
                    lower = lower - np.abs(lower) * MARGIN if k > 1 else lower
                a, b, upper, lower = search.assign(x, a, b, upper, lower)
                distance = search.squared(x, a)
                values = [part.column("vec_id"), part.column("v"), *(pa.array(v.astype(np.int32)) for v in (a, b)), pa.array(upper), pa.array(lower), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(values, ["vec_id", "v", "a", "b", "upper", "lower", "distance"])

    return state.mapInArrow(tidied(work), STATE)


def _sums(state: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Each cluster's size and exact sums of components: k rows a task, added up by Spark."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            a = batch.column("a").to_numpy()
            for j in np.unique(a).tolist():
                # A batch of under 2^31 rows of components under 2^31 can't overflow.
                own = x[a == j]
                now = [len(own), *own.sum(0).tolist()]
                total[j] = [p + q for p, q in zip(total.get(j, [0] * (dims + 1)), now, strict=True)]
        rows = [(j, i, str(v)) for j, vs in total.items() for i, v in enumerate(vs)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.string()))], ["a", "i", "s"])

    parts = state.select("v", "a").mapInArrow(tidied(work), "a int, i int, s string")
    found = parts.groupBy("a", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # k * (dims + 1) rows
    out: dict[int, tuple[int, list[int]]] = {}
    for j in {r["a"] for r in found}:
        row = {r["i"]: int(r["s"]) for r in found if r["a"] == j}
        out[j] = row[0], [row[i + 1] for i in range(dims)]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, salt: str = "1") -> tuple[DataFrame, np.ndarray]:
    """Assignments (vec_id, v, a, b, distance) after `rounds` updates, and the centroids they belong to.

    `vectors` has vec_id and v, as `quantised` gives them. Every round assigns each vector to the nearest centroid (ties: the
    smaller number), then replaces each centroid that has vectors by their componentwise floor(sum / count); empty ones stay.
    Then vectors are assigned once more. Equal vectors may start as several centroids; the first of them gets all vectors.
    Rows that repeat or have no id count as often as they come. An empty table has no centroids and no rows.
    """
    spark = vectors.sparkSession
    path = store.new_path(spark, "shallot-vectors")
    held = store.written_to(vectors.select("vec_id", "v"), path)
    now = first_centroids(held, k, salt)
    if not len(now):
        return held.select("vec_id", "v", *(F.lit(None).cast(t).alias(n) for n, t in (("a", "int"), ("b", "int"), ("distance", "long")))), now.reshape(0, dims)
    before = None
    for step in range(rounds + 1):
        last, path = path, store.new_path(spark, f"shallot-{step}")
        held = store.written_to(_round(held, now, before), path)
        store.drop(spark, last)  # nothing but this round reads it
        if step < rounds:
            before, now = now, now.copy()
            for j, (n, sums) in _sums(held, dims).items():
                now[j] = [s // n for s in sums]
    return held.select("vec_id", "v", "a", "b", "distance"), now


def centroid_sha256(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, the distances' sum over the cluster and over all, and the centroid's digest.

    Sums beyond a long are held at its largest value. The joined list has k rows.
    """
    spark = assigned.sparkSession
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    per = [(r["a"], int(r["s"])) for r in assigned.groupBy("a").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()]
    total = sum(s for _, s in per)
    rows = [(j, str(s), centroid_sha256(centroids[j])) for j, s in per]
    listed = spark.createDataFrame(rows, "cluster int, s string, centroid_sha256 string")
    capped = F.least(F.col("s").cast("decimal(38,0)"), most).cast("long").alias("cluster_inertia")
    listed = listed.select("cluster", capped, F.lit(min(total, 2**63 - 1)).cast("long").alias("inertia"), "centroid_sha256")
    return assigned.withColumnRenamed("a", "cluster").join(F.broadcast(listed), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
