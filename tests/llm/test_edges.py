"""Every operator and pipeline stage on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontamination, hilbert_shards, jaccard_join, language_id, line_dedup, packing, quality_rules, token_binary, toxicity, warc
from tessera.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, h1 string, drop string, doc string, rank long, batch int, toxic int"
LONG = "lorem ipsum dolor sit amet " * 20_000


def documents(spark):
    texts = ["one two three four five six", None, "", "   ", "\n\n\n", LONG, "one two three four five six", "a\tb\x0bc", "Größe über ÄÖÜ é", "\U0001f600 \U00010400 x"]
    rows = [(i, t, None if i % 4 == 3 else "en", None if i % 5 == 0 else "s", None, "r", "h", "d", "x", 1, 2, 1) for i, t in enumerate(texts)]
    rows += [rows[0], rows[1], (None, "no id at all", None, None, 1, *["c"] * 4, 1, 2, 0), (None, None, None, None, None, *["c"] * 4, 1, 2, 0)]
    return spark.createDataFrame(rows, SCHEMA)


def benchmark(spark):
    return spark.createDataFrame([(1, "two three four five"), (2, None), (None, "x y"), (3, ""), (1, "two three four five")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(0, 0), (5, 1), (None, 1), (1, None)], "doc_id long, toxic int")


OPS = {
    "op1": lambda s, d: jaccard_join.near_duplicates(d),
    "op1_keep": lambda s, d: jaccard_join.keep_one(d),
    "op2": lambda s, d: language_id.identify(d, language_id.train(d, dims=64)),
    "op3": lambda s, d: token_binary.encode_corpus(d, tokenizer_path()),
    "op4": lambda s, d: line_dedup.dedup_lines(d),
    "op5": lambda s, d: packing.pack_documents(d, tokenizer_path()),
    "op6": lambda s, d: warc.archive_pages(d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "row", "h1")),
    "op7": lambda s, d: quality_rules.apply_policy(quality_rules.ledger(d)),
    "op8": lambda s, d: decontamination.search(d, benchmark(s)),
    "op8_drop": lambda s, d: decontamination.drop_contaminated(d, benchmark(s)),
    "op9": lambda s, d: toxicity.rate(d, toxicity.train(d, labels(s))),
    "op10": lambda s, d: hilbert_shards.shard(d),
}


@pytest.mark.parametrize("name", OPS)
def test_awkward_rows(spark, name):
    docs = documents(spark)
    out = OPS[name](spark, docs).collect()
    whole = {"op1", "op2", "op3", "op4", "op6", "op7", "op8", "op9", "op10"}
    if name in whole:
        assert len(out) == docs.count()
        key = "page_id" if name == "op6" else "doc_id"
        ids = [r["doc"]["doc_id"] if name == "op4" else r[key] for r in out]
        assert sorted(ids, key=lambda i: (i is None, i)) == sorted((r["doc_id"] for r in docs.collect()), key=lambda i: (i is None, i))


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, name):
    assert OPS[name](spark, documents(spark).limit(0)).collect() == []


def kept_rows(name, rows):
    """What a stage leaves of the rows above: ids 0 and 6 are copies, and row 0 repeats; id 0 holds the item's words."""
    if name == "line_dedup":
        return [(*r[:4], None if r[1] is None else len(r[1]), *r[5:]) for r in rows]
    if name == "jaccard_join":
        return [*rows[:6], *rows[7:10], *rows[11:]]
    if name == "decontamination":
        return [r for r in rows if not (r[1] or "").startswith("one two")]
    return [r for r in rows if r[1] != LONG]  # the one text that is labelled toxic


@pytest.mark.parametrize("at", range(5))
@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tmp_path, at, empty):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark).limit(0) if empty else documents(spark)
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    assert not empty or rows == []
    if not empty and at < 4:
        assert Counter(map(tuple, rows)) == Counter(kept_rows(name, [tuple(r) for r in docs.collect()]))
    if at < 4:
        assert out.columns == docs.columns
        assert out.dtypes == docs.dtypes
