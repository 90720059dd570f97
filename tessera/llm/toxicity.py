"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(severity > k) = sigmoid(w.x - theta_k) with one weight vector for all thresholds
theta_0 < theta_1 < ...; the expected severity is the sum of these chances. Features are the
distinct words of a text and their character 4- and 5-grams (those at a word's start apart),
hashed; only features that labelled texts tie to toxicity have weights.

The labels say only whether a text is toxic. Its grade is weak: 0 if it isn't, else 1, 2 or 3
by the number of its distinct words (0-1, 2-3, more) that hold a feature which toxic labelled
texts have far oftener than others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import store
from tessera.llm.textarrow import ALNUM, distinct, slices, spans, tidied

_BITS = 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
GRADES = 4


def _bucket(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind)) * _MULT
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) * _MULT >> np.uint64(64 - _BITS)).astype(np.int64)


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each distinct word, a row a place where one is: values and the words that they are of."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    offsets = offsets - offsets[0]
    word = np.repeat(np.arange(n), np.diff(offsets))
    place = np.arange(len(data)) - offsets[:-1][word]
    powers = np.full(int(place.max()) + 1, _MULT)
    powers[0] = 1
    powers = np.cumprod(powers)
    feats, owner = [_bucket(np.add.reduceat(data * powers[place], offsets[:-1]), 1)], [np.arange(n)]
    for k in (4, 5):
        m = len(data) - k + 1
        if m <= 0:
            continue
        value = np.zeros(m, np.uint64)
        for i in range(k):
            value = value * np.uint64(257) + data[i : i + m]
        inside = np.flatnonzero(word[:m] == word[k - 1 :])
        value, of = value[inside], word[inside]
        first = place[inside] == 0
        feats += [_bucket(value, 2 * k), _bucket(value[first], 2 * k + 1)]
        owner += [of, of[first]]
    return np.concatenate(feats), np.concatenate(owner)


def grouped_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same in the order of the words, with the words' offsets."""
    feats, owner = word_features(words)
    return feats[np.argsort(owner, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))]).astype(np.int64)


def doc_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each text's distinct words once: text numbers, word codes, and the words by code."""
    found = spans(texts, ALNUM, fold=True)
    codes, words = found.codes()
    key = distinct(found.text_of() << 32 | codes)
    return key >> 32, key & 0xFFFFFFFF, words


@dataclass
class OrdinalModel:
    """`weights` by hashed feature (zero where a feature has none) and `GRADES - 1` rising thresholds."""

    features: np.ndarray
    values: np.ndarray
    thresholds: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        """w.x of each text: the sum over its distinct words of their features' weights."""
        weights = np.zeros(1 << _BITS)
        weights[self.features] = self.values
        doc, word, words = doc_words(texts)
        feats, owner = word_features(words)
        each = np.bincount(owner, weights=weights[feats], minlength=len(words))
        return np.bincount(doc, weights=each[word], minlength=len(texts)) if len(word) else np.zeros(len(texts))

    def chances(self, texts: pa.Array) -> np.ndarray:
        """P(severity > k) for each text and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - self.score(texts)[:, None], -60, 60)))


def fit_cumulative_links(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grades: np.ndarray, n_features: int, steps: int = 400, l2: float = 1e-4, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds for grades 0 .. GRADES - 1 by gradient steps on the likelihood of the levels.

    The thresholds are one base and positive gaps (softplus), so they never cross.
    """
    n = len(grades)
    above = (grades[:, None] > np.arange(GRADES - 1)).astype(float)
    toxic = np.maximum((grades > 0).sum(), 1)
    weight = np.where(grades > 0, 0.5 * n / toxic, 0.5 * n / max(n - toxic, 1))[:, None] / n
    params = np.zeros(n_features + GRADES - 1)
    params[n_features] = 1.0
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        w, raw = params[:n_features], params[n_features:]
        gaps = np.logaddexp(0, raw[1:])
        theta = raw[0] + np.concatenate([[0], np.cumsum(gaps)])
        s = np.bincount(rows, weights=vals * w[cols], minlength=n)
        err = weight * (1 / (1 + np.exp(np.clip(theta[None, :] - s[:, None], -60, 60))) - above)
        by_row = err.sum(axis=1)
        gw = np.bincount(cols, weights=vals * by_row[rows], minlength=n_features) + l2 * w
        g_theta = -err.sum(axis=0)
        tails = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([gw, [tails[0]], tails[1:] / (1 + np.exp(-raw[1:]))])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    raw = params[n_features:]
    return params[:n_features], raw[0] + np.concatenate([[0], np.cumsum(np.logaddexp(0, raw[1:]))])


def likelihood_ratio(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """How much likelier the counts of a feature's documents are if its share differs by class (G squared); it holds at counts of zero and in small samples."""
    n = n_toxic + n_clean
    seen = toxic + clean
    cells = ((toxic, seen, n_toxic), (clean, seen, n_clean), (n_toxic - toxic, n - seen, n_toxic), (n_clean - clean, n - seen, n_clean))
    # A cell without documents adds nothing.
    return 2 * sum((F.when(k > 0, k * F.log(k * n / (m * size))).otherwise(0.0) for k, m, size in cells), F.lit(0.0))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 5000, most_features: int = 4096, least_docs: int = 5) -> OrdinalModel | None:
    """Fit on a bounded sample: of each class the `per_class` labelled documents of the smallest hashes.

    Labels without an id, a class or a document are left out; a document with several is toxic if one says so.
    Tasks find the features; the driver gets the `most_features` of the greatest likelihood ratio and
    the sample's sparse rows. A feature is in `least_docs` documents, or in as many as are toxic if these are fewer.
    None if a class has no texts, or no such feature exists (no words).
    """
    named = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    # Labels whose document isn't there would take places of the sample.
    named = store.written(named.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi"), "labelled")
    sizes = {r["toxic"]: r["n"] for r in named.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    hashed = named.withColumn("h", F.xxhash64("doc_id", F.lit("toxicity")))
    parts = [hashed.filter((F.col("toxic") == t) & (F.pmod("h", F.lit(1 << 20)) < min(1 << 20, int((1 << 20) * 1.3 * per_class / n) + 64))).orderBy("h").limit(per_class) for t, n in sorted(sizes.items())]
    sample = parts[0].unionByName(parts[1]).select("doc_id", "toxic")
    # At most 2 * per_class rows of two numbers.
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null").join(F.broadcast(sample), "doc_id").select("text", "toxic").persist()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs_of = np.zeros((2, 1 << _BITS), np.int32), [0, 0]
        for batch in slices(batches, "text", 4 << 20):
            toxic = batch.column("toxic").to_numpy().astype(np.int64)
            doc, word, words = doc_words(batch.column("text"))
            feats, of = grouped_features(words)
            per = np.diff(of)[word]
            at = np.repeat(of[:-1][word] - (np.cumsum(per) - per), per) + np.arange(per.sum())
            key = distinct(np.repeat(doc, per) << _BITS | feats[at])
            for t in (0, 1):
                counts[t] += np.bincount(key[toxic[key >> _BITS] == t] & ((1 << _BITS) - 1), minlength=1 << _BITS).astype(np.int32)
                docs_of[t] += int((toxic == t).sum())
        some = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[0][some], docs_of[0]).astype(np.int64)), pa.array(np.append(counts[1][some], docs_of[1]).astype(np.int64))], ["f", "clean", "toxic"])

    tallied = chosen.mapInArrow(tidied(tally), "f long, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).persist()
    total = tallied.filter("f = -1").first()
    if not total or not total["clean"] or not total["toxic"]:
        chosen.unpersist(), tallied.unpersist()
        return None
    odds = F.log((F.col("toxic") + 0.5) / (total["toxic"] + 1.0)) - F.log((F.col("clean") + 0.5) / (total["clean"] + 1.0))
    ratio = likelihood_ratio(F.col("toxic"), F.col("clean"), total["toxic"], total["clean"])
    best = tallied.filter(f"f >= 0 and toxic + clean >= {min(least_docs, total['toxic'])}").select("f", odds.alias("odds"), ratio.alias("ratio")).orderBy(F.desc("ratio"), "f").limit(most_features).collect()
    if not best:
        chosen.unpersist(), tallied.unpersist()
        return None
    features = np.array([r["f"] for r in best], np.int64)
    marks = np.array([r["odds"] > 3.0 for r in best])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(1 << _BITS, -1, np.int64)
        slot[features] = np.arange(len(features))
        for batch in slices(batches, "text", 4 << 20):
            doc, word, words = doc_words(batch.column("text"))
            feats, of = grouped_features(words)
            marked = np.concatenate([[0], np.cumsum((slot[feats] >= 0) & marks[slot[feats]])])
            strong = np.bincount(doc, weights=(marked[of[1:]] > marked[of[:-1]])[word], minlength=batch.num_rows)
            kept = np.flatnonzero(slot[feats] >= 0)
            of = np.searchsorted(kept, of)
            per = np.diff(of)[word]
            at = np.repeat(of[:-1][word] - (np.cumsum(per) - per), per) + np.arange(per.sum())
            key, times = np.unique(np.repeat(doc, per) << _BITS | slot[feats[kept[at]]], return_counts=True)
            bounds = pa.array(np.searchsorted(key >> _BITS, np.arange(batch.num_rows + 1)), pa.int32())
            cols = pa.ListArray.from_arrays(bounds, pa.array((key & ((1 << _BITS) - 1)).astype(np.int32)))
            vals = pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(strong.astype(np.int32)), cols, vals], ["toxic", "strong", "cols", "vals"])

    table = chosen.mapInArrow(tidied(rows_of), "toxic int, strong int, cols array<int>, vals array<int>").toArrow()
    chosen.unpersist(), tallied.unpersist()
    toxic, strong = table["toxic"].to_numpy(), table["strong"].to_numpy()
    grades = np.where(toxic == 0, 0, 1 + (strong > 1) + (strong > 3))
    cols, vals = table["cols"].combine_chunks(), table["vals"].combine_chunks()
    rows = np.repeat(np.arange(len(grades)), np.asarray(cols.value_lengths()))
    cols = np.asarray(cols.flatten()).astype(np.int64)
    # Features of little evidence count for little: in small samples most of the kept ones are chance.
    scale = np.array([max(r["ratio"], 0.0) for r in best])
    scale = (scale / max(scale.max(), 1e-9)) ** 0.75
    weights, theta = fit_cumulative_links(rows, cols, np.asarray(vals.flatten()) * scale[cols], grades, len(features))
    return OrdinalModel(features, weights * scale, theta)


def _rated(batch: pa.RecordBatch, model: OrdinalModel | None) -> np.ndarray:
    if model is None:
        return np.zeros((batch.num_rows, GRADES - 1))
    return model.chances(batch.column("text"))


def rate(docs: DataFrame, model: OrdinalModel | None, cut: float = 0.5) -> DataFrame:
    """doc_id, severity (expected, 0 to 3), grade (the highest whose chance reaches `cut`), p_toxic and toxic of every whole text.

    Null texts count as empty. Without a model (no labels of both classes) all are 0.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            p = _rated(batch, model)
            grade = (p >= cut).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(p[:, 0]), pa.array(grade > 0)], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(work), "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel | None, cut: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, that aren't rated toxic."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            yield batch.filter(pa.array(_rated(batch, model)[:, 0] < cut))

    return docs.mapInArrow(tidied(work), docs.schema)
