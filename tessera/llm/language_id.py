"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of an n-gram binds (multiplies) its
letters' vectors, each permuted (rotated) by its place from the end; a text's vector bundles
(adds) those of its n-grams. A language's prototype bundles the unit vectors of its training
texts, so one long text does not outweigh many. A text gets the language whose prototype has
the greatest cosine with its vector.

Letters are the code points that are letters, lower-cased; all else is one gap between words.
Each code point's vector comes from a seeded hash of it, so every letter of every script has its
own, and a batch makes those of the letters that it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.textarrow import buffers, slices, tidied

#: The label of texts without letters.
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """The lower-case form of each letter of the basic plane, 0 for what is no letter."""
    table = np.zeros(1 << 16, np.int32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_LETTERS = _letters()


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts as code points (0: no letter), and the texts' offsets."""
    data, offsets = buffers(texts)
    wide = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    point = _LETTERS[np.minimum(wide, 0xFFFF)]
    beyond = np.flatnonzero(wide > 0xFFFF)
    if len(beyond):
        kinds, which = np.unique(wide[beyond], return_inverse=True)
        point[beyond] = np.array([ord(chr(c).lower()) if chr(c).isalpha() else 0 for c in kinds], np.int32)[which]
    return point, lead[offsets]


@dataclass
class Profiles:
    """What a text is compared with: a prototype a language, and what the letters' vectors are made from."""

    langs: list[str]
    prototypes: np.ndarray  # languages x dimensions, unit rows
    gram: int = 3
    dims: int = 1024
    seed: int = 7

    def letter_vectors(self, points: np.ndarray) -> np.ndarray:
        """The vectors of code points: bits of a hash (splitmix64) of the seed, the code point and the place."""
        words = -(-self.dims // 64)
        x = points.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64) + (np.uint64(self.seed) << np.uint64(40))
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(len(points), -1), axis=1)[:, : self.dims]
        return bits.astype(np.int8) * np.int8(2) - np.int8(1)

    def gram_vectors(self, letters: np.ndarray, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The vectors of the n-grams that begin at the places `first` of `code` (rows of `letters`)."""
        out = np.ones((len(first), self.dims), np.int8)
        for k in range(self.gram):
            out *= np.roll(letters[code[first + self.gram - 1 - k]], k, axis=1)
        return out.astype(np.float32)

    def vectors(self, texts: pa.Array, cells: int = 2 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of the texts (zeros without n-grams) and which texts have letters."""
        points, offsets = _points(texts)
        n = len(offsets) - 1
        there = np.zeros(0x110000, bool)
        there[points] = there[0] = True
        alphabet = np.flatnonzero(there)
        code = np.cumsum(there)[points] - 1
        doc = np.repeat(np.arange(n), np.diff(offsets))
        letters = np.bincount(doc[code > 0], minlength=n) > 0
        # A gap before and after each text and one for each run of other characters.
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] > 0) | (code[:-1] > 0) | (doc[1:] != doc[:-1])
        code, doc = code[keep], doc[keep]
        edge = np.flatnonzero(np.diff(doc, prepend=-1)) if len(doc) else np.zeros(0, np.int64)
        code, doc = np.insert(code, edge, 0), np.insert(doc, edge, doc[edge] if len(edge) else 0)
        code, doc = np.append(code, 0), np.append(doc, -1)
        g = self.gram
        grams, top = np.zeros(max(len(code) - g + 1, 0), np.int64), 1
        for k in range(g):
            if top * len(alphabet) >= 1 << 62:
                kinds, grams = np.unique(grams, return_inverse=True)
                top = len(kinds)
            grams, top = grams * len(alphabet) + code[k : len(code) - g + 1 + k], top * len(alphabet)
        # Within one text, and not of gaps at both of the last two places.
        inside = (doc[: len(grams)] == doc[g - 1 :]) & (code[g - 1 :] + (code[g - 2 : -1] if g > 1 else 0) > 0)
        begins = np.flatnonzero(inside)
        grams, doc = grams[begins], doc[begins]
        # The distinct n-grams, a place where each is, and the number of each place's.
        if top <= 1 << 20:
            place = np.full(top, -1, np.int64)
            place[grams] = begins
            kinds = np.flatnonzero(place >= 0)
            first, at = place[kinds], (np.cumsum(place >= 0) - 1)[grams]
        else:
            kinds, first, at = np.unique(grams, return_index=True, return_inverse=True)
            first = begins[first]
        letters_of = self.letter_vectors(alphabet)
        out = np.zeros((n, self.dims), np.float32)
        pairs, times = np.unique(doc * max(len(kinds), 1) + at, return_counts=True) if n * len(kinds) > 20 * len(at) else (None, None)
        if pairs is not None and n * len(kinds) > 20 * len(pairs):
            # Few n-grams are shared: each text's vectors are added as they are.
            step = max(1, cells // self.dims)
            for lo in range(0, len(pairs), step):
                row, kind = pairs[lo : lo + step] // len(kinds), pairs[lo : lo + step] % len(kinds)
                heads = np.flatnonzero(np.diff(row, prepend=-1))
                out[row[heads]] += np.add.reduceat(self.gram_vectors(letters_of, code, first[kind]) * times[lo : lo + step, None].astype(np.float32), heads)
        else:
            # A product of counts and vectors, at most `cells` counts and so many vectors' places at a time.
            step = max(1, 4 * cells // self.dims)
            for left in range(0, len(kinds), step):
                vectors = self.gram_vectors(letters_of, code, first[left : left + step])
                mine = np.flatnonzero((at >= left) & (at < left + step)) if len(kinds) > step else slice(None)
                own, kind, wide = doc[mine], at[mine] - left, len(vectors)
                rows = max(1, cells // wide)
                for a in range(0, n, rows):
                    b = min(a + rows, n)
                    lo, hi = np.searchsorted(own, [a, b])
                    counts = np.bincount((own[lo:hi] - a) * wide + kind[lo:hi], minlength=(b - a) * wide)
                    out[a:b] += counts.reshape(b - a, wide).astype(np.float32) @ vectors
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0), letters

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """A language (`und` without letters) and its cosine, 0 to 1, of each text."""
        unit, letters = self.vectors(texts)
        if not self.langs:
            return [UNKNOWN] * len(unit), np.zeros(len(unit))
        cosine = unit @ self.prototypes.T
        best = cosine.argmax(axis=1)
        score = np.where(letters, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0).astype(np.float64)
        return [self.langs[k] if has else UNKNOWN for k, has in zip(best, letters, strict=True)], score


def held_out() -> Column:
    """True for documents that training never sees: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, gram: int = 3, dims: int = 1024, texts_per_lang: int = 2000) -> Profiles:
    """Fit profiles on whole texts of `docs` (doc_id, text, lang) that aren't held out.

    A bounded sample: of each language the texts whose hash lies under a cut that about `texts_per_lang`
    texts pass, found in the scan. Tasks bundle them and Spark adds the bundles up, as whole numbers so
    that their order doesn't count; the driver gets a vector a language. Without training rows the
    profiles know no language and predict `und`.
    """
    spark = docs.sparkSession
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("lang", F.col("lang").cast("string"))
    blank = Profiles([], np.zeros((0, dims), np.float32), gram, dims)
    span = 1 << 30
    cuts = [(r["lang"], min(span, texts_per_lang * span // r["n"] + 1)) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not cuts:
        return blank
    # A row a language, as many as there are prototypes.
    chosen = rows.join(F.broadcast(spark.createDataFrame(cuts, "lang string, cut long")), "lang")
    chosen = chosen.filter(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(span)) < F.col("cut")).select("lang", "text")
    one = float(1 << 32)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", 2 << 20):
            unit, _ = blank.vectors(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + np.rint(unit[langs == lang].astype(np.float64) * one).astype(np.int64).sum(axis=0)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dims), pa.array(np.arange(dims, dtype=np.int32)), pa.array(v)], ["lang", "dim", "v"])

    added = chosen.mapInArrow(tidied(bundle), "lang string, dim int, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v"))
    vectors: dict[str, np.ndarray] = {}
    for r in added.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "v"))).alias("all")).collect():
        vectors[r["lang"]] = np.array([x["v"] for x in r["all"]], np.float64)
    langs = sorted(k for k, v in vectors.items() if np.linalg.norm(v) > 0)
    if not langs:
        return blank
    prototypes = np.stack([vectors[k] / np.linalg.norm(vectors[k]) for k in langs]).astype(np.float32)
    return Profiles(langs, prototypes, gram, dims)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of `docs` by its whole text."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            lang, score = profiles.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(label), "doc_id long, held_out boolean, lang_pred string, score double")
