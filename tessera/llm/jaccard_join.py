"""N-gram Jaccard join: MinHash banding, then exact Jaccard on full n-gram sets.

1. Each text becomes the set of its n-word shingles (64-bit hashes of word runs), a digest of
   that set, and one hash for each band of MinHash values. Bands and rows are chosen from the
   threshold and a target recall.
2. Texts with equal sets form a copy class with a number of its own; one text of each class goes
   on, so groups of copies never meet in a task.
3. Band hashes are shuffled; a star (smallest member to each other member) stands for each
   bucket, and the stars' components are the candidate groups. No pairs are listed.
4. Classes are dealt to units. A small group is one unit. A large one is cut by star (the smallest
   class that a class shares a bucket with) and then by size, and two units meet only if they
   share a bucket; so what chains groups together costs nothing but the links of the chain.
5. Each unit, and each pair of units that share a bucket, goes to one task, which compares their
   texts on full sets by a product of incidence matrices. It returns only each class's number of
   links and a spanning forest of the linked classes.
6. Components of the forest are the result's classes.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A text of
fewer than n words, but not none, has one shingle; texts without words (null, empty) have no
links and a class of their own. Rows without a doc_id have no links and a null class. Rows are
told apart by doc_id and text: rows that repeat both are copies, and different texts under one
doc_id are classes of their own with links of their own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import components, store
from tessera.llm.textarrow import ALNUM, hash_words, release, slices, spans, tidied

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def choose_bands(threshold: float, recall: float, most_rows: int = 12, most_bands: int = 25) -> tuple[int, int]:
    """Bands b and rows r with 1 - (1 - t^r)^b >= recall at the threshold t: the longest rows with b <= `most_bands`, or, at
    thresholds too low for that, one row and as many bands as the recall needs."""
    if not 0 < threshold <= 1 or not 0 <= recall < 1:
        raise ValueError("a threshold above 0 and at most 1, and a recall below 1")

    def bands(rows: int) -> int:
        p = threshold**rows
        return 1 if p >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-p)))

    rows = next((r for r in range(most_rows, 1, -1) if bands(r) <= most_bands), 1)
    return bands(rows), rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the texts' offsets in them."""
    found = spans(texts, ALNUM, fold=True)
    codes, distinct = found.codes()
    words = hash_words(distinct)[codes]
    counts = found.counts()
    per = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
    doc = np.repeat(np.arange(len(counts)), per)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + found.of[:-1][doc]
    last = found.of[1:][doc]
    value = np.zeros(len(doc), np.uint64)
    for k in range(n):
        at = first + k
        there = at < last
        value[there] = _mix(value[there] * _MIX[0] + words[at[there]] + np.uint64(k + 1))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[keep], doc[keep]
    return value, np.searchsorted(doc, np.arange(len(counts) + 1))


def band_hashes(sets: np.ndarray, offsets: np.ndarray, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """One hash for each band of each set that isn't empty (rows of empty sets are zeros)."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(1, 1 << 62, bands * rows, dtype=np.uint64) | np.uint64(1)
    plus = rng.integers(0, 1 << 62, bands * rows, dtype=np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, bands), np.uint64)
    if not len(full):
        return out
    begins = offsets[:-1][full]
    for band in range(bands):
        value = np.full(len(full), band + 1, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            value = _mix(value * _MIX[0] + np.minimum.reduceat(sets * mult[k] + plus[k], begins))
        out[full, band] = value
    return out


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, t1, t2, d1, d2, size, bands): of each row of `docs` (doc_id, t1, t2, text) the set's 128-bit digest, its size and band hashes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            sets, offsets = shingle_sets(batch.column("text"), n)
            raw = memoryview(sets).cast("B")
            ends = offsets.tolist()
            digest = np.frombuffer(b"".join(hashlib.blake2b(raw[8 * b : 8 * e], digest_size=16).digest() for b, e in zip(ends, ends[1:], strict=False)), np.int64).reshape(-1, 2)
            hashes = band_hashes(sets, offsets, bands, rows).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, hashes.size + 1, bands), pa.int32()), pa.array(hashes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(np.diff(offsets)), lists], ["doc_id", "t1", "t2", "d1", "d2", "size", "bands"])

    return docs.select("doc_id", "t1", "t2", "text").mapInArrow(tidied(sign), "doc_id long, t1 long, t2 long, d1 long, d2 long, size long, bands array<long>")


def _links(a: list[np.ndarray], b: list[np.ndarray], threshold: float, width: int = 4096) -> np.ndarray:
    """Which sets of a and b have a Jaccard similarity of at least the threshold: counts of common
    members are sums of products of 0/1 incidence matrices, `width` members at a time."""
    if not a or not b:
        return np.zeros((len(a), len(b)), bool)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    flat = np.concatenate([*a, *b])
    _, ids, df = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(a) + len(b)), np.concatenate([la, lb]))
    shared = df[ids] > 1
    ids, row = ids[shared], row[shared]
    _, ids = np.unique(ids, return_inverse=True)
    order = np.argsort(ids, kind="stable")
    ids, row = ids[order], row[order]
    common = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, int(ids[-1]) + 1 if len(ids) else 0, width):
        lo, hi = np.searchsorted(ids, [at, at + width])
        m = np.zeros((len(a) + len(b), width), np.float32)
        m[row[lo:hi], ids[lo:hi] - at] = 1
        common += m[: len(a)] @ m[len(a) :].T
    common = common.astype(np.float64)
    return common >= threshold * (la[:, None] + lb[None, :] - common) - 1e-9


def _forest(n: int, us: np.ndarray, vs: np.ndarray) -> list[tuple[int, int]]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for u, v in zip(us.tolist(), vs.tolist(), strict=True):
        ru, rv = find(u), find(v)
        if ru != rv:
            root[ru] = rv
            out.append((u, v))
    return out


def _verifier(n: int, threshold: float):
    """For a unit or a pair of units: rows (node, other, links); other is null in rows that count links."""

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        sets, offsets = shingle_sets(pa.array(pdf["text"], pa.string()), n)
        each = [sets[b:e] for b, e in zip(offsets, offsets[1:], strict=False)]
        nodes, copies = pdf["node"].to_numpy(), pdf["copies"].to_numpy()
        ui, uj = pdf["ui"].iloc[0], pdf["uj"].iloc[0]
        same = ui == uj
        left = np.arange(len(nodes)) if same else np.flatnonzero(pdf["unit"] == ui)
        right = left if same else np.flatnonzero(pdf["unit"] == uj)
        linked = _links([each[i] for i in left], [each[i] for i in right], threshold)
        if same:
            np.fill_diagonal(linked, False)
        counts = np.zeros(len(nodes), np.int64)
        counts[left] += linked @ copies[right]
        if not same:
            counts[right] += copies[left] @ linked
        us, vs = np.nonzero(np.triu(linked) if same else linked)
        tree = _forest(len(nodes), left[us], right[vs])
        some = np.flatnonzero(counts)
        out = pd.DataFrame({"node": np.concatenate([nodes[some], nodes[[u for u, _ in tree]]]), "other": pd.array([None] * len(some) + [nodes[v] for _, v in tree], "Int64"), "links": np.concatenate([counts[some], np.zeros(len(tree), np.int64)])})
        if len(sets) > 1 << 18:
            release()
        return out

    return verify


def _text_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and the 128-bit hash of the text (t1, t2)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def _units(groups: DataFrame, stars: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """(node, unit, whole) of `groups` (node, component, size): `whole` where the component is one unit.

    A cut of m classes has about 4 * sqrt(m) of them in a unit, `block` and `block_shingles` at most,
    so that neither the copies of a text nor a task's rows grow in proportion to the group.
    """

    def parts(by: str) -> DataFrame:
        m, per = F.count("*"), F.least(F.lit(float(block)), F.greatest(F.lit(64.0), 4 * F.sqrt(F.count("*"))))
        return groups_.groupBy(by).agg(F.ceil(F.greatest(m / per, F.sum("size") / block_shingles)).cast("int").alias("parts"))

    groups_ = groups
    whole = parts("component").withColumn("whole", F.col("parts") <= 1).drop("parts")
    groups_ = groups.join(whole, "component")
    # The centre of a node's star: the smallest node that it shares a bucket with, if that is smaller than itself.
    centre = stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("centre"))
    cut = groups_.filter(~F.col("whole")).join(centre, "node", "left").withColumn("label", F.coalesce("centre", "node")).drop("centre")
    groups_ = store.written(groups_.filter("whole").withColumn("label", F.col("component")).unionByName(cut), "dealt")
    dealt = groups_.join(parts("label"), "label")
    return dealt.select("node", F.xxhash64("label", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts"))).alias("unit"), "whole")


def classes_of(docs: DataFrame, threshold: float, n: int, recall: float, block: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """The rows' signatures, and of each class of equal sets (by d1, d2): node, copies, links, and the
    group it is in as `key` (the smallest node) and `rep` (the smallest doc_id, t1, t2 of the group)."""
    rows = _text_rows(docs)
    bands, per_band = choose_bands(threshold, recall)
    signed = store.written(signatures(rows, n, bands, per_band), "signatures")
    classes = signed.filter("doc_id is not null and size > 0").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    # The number is given where the table is written, so it is read and not made again.
    classes = store.written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    buckets = classes.select("node", F.posexplode("bands").alias("band", "hash"))
    least = buckets.groupBy("band", "hash").agg(F.min("node").alias("v"), F.count("*").alias("m")).filter("m > 1").drop("m")
    stars = store.written(buckets.join(least, ["band", "hash"]).filter("node <> v").select(F.col("node").alias("u"), "v").distinct(), "stars")
    groups = components.components(stars).join(classes.select("node", "size"), "node")
    units = store.written(_units(groups, stars, block, block_shingles), "units")

    # Units that share a bucket, and each unit with itself.
    met = buckets.join(units.filter("not whole").select("node", "unit"), "node").select("band", "hash", "unit").distinct()
    across = met.select("band", "hash", F.col("unit").alias("ui")).join(met.select("band", "hash", F.col("unit").alias("uj")), ["band", "hash"]).filter("ui < uj").select("ui", "uj").distinct()
    alone = units.groupBy("unit").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("unit").alias("ui"), F.col("unit").alias("uj"))
    pairs = store.written(alone.unionByName(across), "unit-pairs")
    ends = pairs.select(F.col("ui").alias("unit"), "ui", "uj").unionByName(pairs.filter("ui <> uj").select(F.col("uj").alias("unit"), "ui", "uj"))

    members = units.join(classes.select("node", "copies", "rep.*"), "node").drop("whole")
    # Rows that repeat an id and a text are one here; the join's partitioning serves the grouping too.
    texts = rows.join(members, ["doc_id", "t1", "t2"]).groupBy("doc_id", "t1", "t2", "node", "copies", "unit").agg(F.first("text").alias("text"))
    dealt = texts.select("node", "copies", "text", "unit").join(ends, "unit")
    verified = store.written(dealt.groupBy("ui", "uj").applyInPandas(_verifier(n, threshold), "node long, other long, links long"), "links")

    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components.components(verified.filter("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    known = classes.select("node", "copies", "d1", "d2", "rep").join(links, "node", "left").join(joined, "node", "left").withColumn("key", F.coalesce("component", "node")).drop("component")
    firsts = known.filter("key is not null and links > 0").groupBy("key").agg(F.min("rep").alias("first"))
    known = known.join(firsts, "key", "left").select("d1", "d2", "copies", F.coalesce("links", F.lit(0)).alias("links"), "key", F.coalesce("first", "rep").alias("rep"))
    return signed, known


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, block: int = 1000, block_shingles: int = 1 << 20) -> DataFrame:
    """A row for each row of `docs` (doc_id, text): doc_id, class_id (the smallest doc_id linked to
    it, over any number of links), class_key (a number of the class's own: classes under one doc_id
    differ in it), n_copies (rows of equal sets, itself included) and n_links (other rows whose sets
    have a similarity of the threshold or more). Null and empty texts, and rows without a doc_id, have
    no links, no key, and one copy. An empty table stays empty; further columns are left out."""
    signed, known = classes_of(docs, threshold, n, recall, block, block_shingles)
    found = signed.filter("doc_id is not null and size > 0").select("doc_id", "d1", "d2").join(known, ["d1", "d2"])
    found = found.select("doc_id", F.col("rep.doc_id").alias("class_id"), F.col("key").alias("class_key"), F.col("copies").alias("n_copies"), (F.col("links") + F.col("copies") - 1).alias("n_links"))
    alone = signed.filter("doc_id is null or size = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(None).cast("long").alias("class_key"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, block: int = 1000, block_shingles: int = 1 << 20) -> DataFrame:
    """The rows of `docs`, all columns, but one row for each class of near duplicates: that of the
    smallest doc_id (then text hash). Of rows that repeat its doc_id and text any one stays.

    A different text under the same doc_id is of a class of its own and stays if it is that class's
    first. Rows without a doc_id and texts without words (null, empty) all stay.
    """
    signed, known = classes_of(docs, threshold, n, recall, block, block_shingles)
    # How often each row that stays repeats: most do not, so most texts aren't grouped.
    rows = signed.filter("doc_id is not null and size > 0").groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("n"))
    firsts = store.written(rows.join(known.select("rep.*").distinct(), ["doc_id", "t1", "t2"]), "kept")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    whole = docs.select(F.struct("*").alias("row"), key.alias("key")).select("row", "key.*")

    def among(n_: str) -> DataFrame:
        return whole.join(firsts.filter(n_).select("doc_id", "t1", "t2"), ["doc_id", "t1", "t2"], "left_semi")

    once = among("n = 1").unionByName(among("n > 1").dropDuplicates(["doc_id", "t1", "t2"])).select("row.*")
    wordless = docs.filter(F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").cast("string").rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"))
    return once.unionByName(wordless)
