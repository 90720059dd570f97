"""Sequential work on one conversation: batches, pieces, embeddings, model calls and JSON repair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Greedy:
    """Greedy batch numbers (from 0) of sizes that come one by one: a batch closes when the next item would pass `most`; one item always fits."""

    def __init__(self, most: int):
        self.most, self.size, self.no = most, 0, 0

    def number(self, size: int) -> int:
        if self.size and self.size + size > self.most:
            self.no, self.size = self.no + 1, 0
        self.size += size
        return self.no


def batched(items: DataFrame, group: str, order: str, text: str, most: int) -> DataFrame:
    """Items with the number of their batch in their group.

    Each group is read once in its order, a row at a time across Arrow batches, so a long one is never an array in
    memory; Python sees sizes only and hands the other columns on."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, greedy = None, Greedy(most)
        for batch in batches:
            numbers = []
            for key, size in zip(batch.column(group).to_pylist(), batch.column("_size").to_pylist(), strict=True):
                if key != at:
                    at, greedy = key, Greedy(most)
                numbers.append(greedy.number(size))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(numbers, pa.int32())], [group, order, text, "batch"])

    rows = items.select(group, order, text, F.coalesce(F.length(text), F.lit(0)).alias("_size")).repartition(group).sortWithinPartitions(group, order)
    return rows.mapInArrow(work, rows.drop("_size").withColumn("batch", F.lit(None).cast("int")).schema)


def split_text(text: Column, most: int) -> Column:
    """Pieces of at most `most` characters: the rest if it fits, else up to its last line end that does, else cut there."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(.{{1,{most}}}\z|.{{0,{most - 1}}}\n|.{{1,{most}}})"), F.lit(1))


def split_pieces(turns: DataFrame, most: int = 1000) -> DataFrame:
    """(conv_id, seq, key, part, parts, text): whole turns, or parts with keys `seq#part`."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("int").alias("seq"), F.coalesce("text", F.lit("")).alias("text"))
    whole = F.length("text") <= most
    pieces = rows.select("conv_id", "seq", whole.alias("whole"), F.when(whole, F.array("text")).otherwise(split_text(F.col("text"), most)).alias("pieces"))
    each = pieces.select("conv_id", "seq", "whole", F.size("pieces").alias("parts"), F.posexplode("pieces").alias("part", "text"))
    seq = F.col("seq").cast("string")
    return each.select("conv_id", "seq", F.when(F.col("whole"), seq).otherwise(F.concat(seq, F.lit("#"), F.col("part").cast("string"))).alias("key"), "part", "parts", "text")


def embed(rows: DataFrame, key: str, text: str, fn: Callable[[list[str]], list[list[float]]], most_items: int = 128, most_chars: int = 80_000, report: bool = False) -> DataFrame:
    """(key, embedding) by a given function, in batches of bounded count and length; blank texts and failed batches get null.

    With `report` a column `error` says why a batch failed, so that a failure can be told from a blank text."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors: list = [None] * len(pdf)
            errors: list = [None] * len(pdf)
            held, size = [], 0

            def flush() -> None:
                if held:
                    try:
                        for i, v in zip(held, fn([pdf[text].iloc[i] for i in held]), strict=True):
                            vectors[i] = list(v)
                    except Exception as e:  # a failed batch leaves its rows without vectors; the run goes on
                        for i in held:
                            vectors[i], errors[i] = None, f"{type(e).__name__}: {e}"
                    held.clear()

            for i, t in enumerate(pdf[text]):
                if not (t or "").strip():
                    continue
                if held and (len(held) >= most_items or size + len(t) > most_chars):
                    flush()
                    size = 0
                held.append(i)
                size += len(t)
            flush()
            yield pd.DataFrame({key: pdf[key], "embedding": vectors} | ({"error": errors} if report else {}))

    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInPandas(work, f"{key} {kind}, embedding array<float>" + (", error string" if report else ""))


def hashing_embedder(width: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for a model: signed counts of hashed words, unit length."""
    import zlib

    def fn(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * width
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % width] += 1.0 if h >> 31 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return fn


def repair_json(text: Column) -> Column:
    """The outermost JSON object of a model's answer as a map of texts: thinking and fences go, bad escapes are doubled, an
    open string or object is closed; null where none of this makes it readable."""
    # A model's thought, and the fences around its whole answer. Fences inside of it are text.
    body = F.trim(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), F.lit(" \t\r\n"))
    body = F.regexp_replace(F.regexp_replace(body, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    body = F.substring(body, F.greatest(F.instr(body, "{"), F.lit(1)), F.length(body))
    body = F.when(F.contains(body, F.lit("}")), F.regexp_extract(body, r"(?s)^(.*\})", 1)).otherwise(body)
    tries = (body, F.regexp_replace(body, r'\\(?!["\\/bfnrtu])', r"\\\\"), F.concat(body, F.lit('"}')), F.concat(body, F.lit("}")))
    read = F.coalesce(*(F.from_json(t, "map<string,string>", {"allowUnquotedControlChars": "true"}) for t in tries))
    return F.when(F.startswith(body, F.lit("{")), read)


def translate(pieces: DataFrame, fn: Callable[[dict[str, str]], dict[str, str]]) -> DataFrame:
    """(conv_id, seq, text): pieces translated by a given function of {key: text} and rejoined by turn; a turn that lacks a part is left out.

    Keys are unique in a conversation only, so each call gets pieces of one."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, own in pdf.groupby("conv_id", sort=False, dropna=False):
                got = fn(dict(zip(own["key"], own["text"], strict=True)))
                yield own.assign(text=[got.get(k) for k in own["key"]])

    done = pieces.mapInPandas(work, pieces.schema).filter("text is not null")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "")
    return done.groupBy("conv_id", "seq").agg(whole.alias("text"), F.count("*").alias("n"), F.max("parts").alias("parts")).filter("n = parts").drop("n", "parts")
