"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each text; the ledger keeps the measurements and one bit for
each rule that fails. A policy is a versioned mask: it keeps a text if no bit of its mask is
set. Policies are applied and compared on the ledger alone, without the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import store
from tessera.llm.textarrow import LEAD, SPACED, byte_class, dense_ranks, lines, slices, spans, tidied

_SYMBOLS = byte_class(b"#*$%&|<>")
_LETTERS = byte_class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_BULLETS = (b"-", b"*", "•".encode())
_ELLIPSES = (b"...", "…".encode())
_WINDOW = 8

#: The rules by bit, as conditions on the measurements that a text fails.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("very_many_words", "n_words > 1000000"),
    ("bullet_lines", "10 * n_bullet_lines > 9 * n_worded_lines"),
    ("ellipsis_lines", "10 * n_ellipsis_lines > 3 * n_worded_lines"),
    ("few_letter_words", "10 * n_letter_words < 8 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: The two rules that no policy can leave out.
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Policies by version; a version never changes once it is given out.
POLICIES = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["duplicate_lines"] | BIT["short_words"] | BIT["long_words"] | BIT["very_many_words"],
}
POLICIES["v2"] = POLICIES["v1"] | BIT["bullet_lines"] | BIT["ellipsis_lines"] | BIT["few_letter_words"]
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_worded_lines", "n_bullet_lines", "n_ellipsis_lines", "n_letter_words")


def _holds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: bytes) -> np.ndarray:
    """Which of the ranges from `starts` on, that end at `ends` or later, begin with these bytes."""
    fits = ends - starts >= len(word)
    for k, byte in enumerate(word):
        fits[fits] = data[starts[fits] + k] == byte
    return fits


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each whole text (null: no words)."""
    found = spans(texts, SPACED)
    n = len(found.offsets) - 1
    text_of = found.text_of()
    lead = np.concatenate([[0], np.cumsum(LEAD[found.data])])
    symbol = np.concatenate([[0], np.cumsum(_SYMBOLS[found.data])])
    chars = np.bincount(text_of, weights=lead[found.ends] - lead[found.starts], minlength=n).astype(np.int64)

    # Exact ranks of 1, 2, 4 and 8 words: equal ranks mean equal windows, no hash is trusted.
    codes, _ = found.codes()
    ranks = codes
    for width in (1, 2, 4):
        ranks = dense_ranks(ranks[: len(ranks) - width] * np.int64(len(codes) + 1) + ranks[width:]) if len(ranks) > width else ranks[:0]
    last = np.searchsorted(found.of, np.arange(len(ranks)) + _WINDOW)  # a window ends in the text it starts in
    whole = last == np.searchsorted(found.of, np.arange(len(ranks)) + 1)
    start = np.flatnonzero(whole)
    _, where, times = np.unique(text_of[start] * np.int64(len(codes) + 1) + ranks[start], return_inverse=True, return_counts=True)
    again = start[times[where] > 1]
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + _WINDOW, -1)
    repeated = np.bincount(text_of[np.cumsum(cover)[:-1] > 0], minlength=n)

    of, starts, ends, line = lines(texts)
    line_text = np.repeat(np.arange(n), np.diff(of))
    first_word, after = np.searchsorted(found.starts, starts), np.searchsorted(found.starts, ends)
    worded = after > first_word
    per_text = lambda which: np.bincount(line_text[worded][which], minlength=n)
    begins, stops = found.starts[first_word[worded]], found.ends[after[worded] - 1]
    tail = found.starts[after[worded] - 1]
    bullet = np.logical_or.reduce([_holds(found.data, begins, stops, b) for b in _BULLETS])
    ellipsis = np.logical_or.reduce([_holds(found.data, np.maximum(stops - len(e), tail), stops, e) for e in _ELLIPSES])
    letter = np.concatenate([[0], np.cumsum(_LETTERS[found.data])])
    lettered = letter[found.ends] > letter[found.starts]
    bullets, ellipses, some = per_text(bullet), per_text(ellipsis), per_text(np.ones(len(begins), bool))
    key = line_text * np.int64(len(line) + 1) + line
    _, first = np.unique(key, return_index=True)
    later = worded.copy()
    later[first] = False
    return {
        "n_words": found.counts(),
        "word_chars": chars,
        "n_symbols": np.diff(symbol[found.offsets]),
        "n_dup_lines": np.bincount(line_text[later], minlength=n),
        "n_repeat_words": repeated,
        "n_lines": np.diff(of),
        "n_worded_lines": some,
        "n_bullet_lines": bullets,
        "n_ellipsis_lines": ellipses,
        "n_letter_words": np.bincount(text_of[lettered], minlength=n),
    }


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and `failed`: the bits of the rules that the text fails."""

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got = measure(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(got[m].astype(np.int64)) for m in MEASURES)], ["doc_id", *MEASURES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = rows.mapInArrow(tidied(evaluate), "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)) for name, fails in RULES]
    return measured.withColumn("failed", reduce(Column.bitwiseOR, bits))


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger as a table: rules are evaluated once, whatever policies and counts are read from it."""
    return store.written(ledger(docs), "ledger")


def apply_policy(rows: DataFrame, version: str = "v2") -> DataFrame:
    """Add base_failed and kept (never true of a text that fails a base rule) to a ledger."""
    failed = F.col("failed")
    return rows.withColumn("base_failed", failed.bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", failed.bitwiseAND(F.lit(BASE | POLICIES[version])) == 0)


def ablations(rows: DataFrame, version: str = "v2") -> DataFrame:
    """For each rule of a policy: texts it fails, and texts that the policy would win back without it.

    The ledger is first counted by its bits (at most 2 to the number of rules groups), then the
    counts are read once for each rule.
    """
    mask = BASE | POLICIES[version]
    counts = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bit).alias("bit")) for name, bit in BIT.items() if bit & mask)))
    each = counts.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_won_back"),
    )
