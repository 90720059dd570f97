"""A training corpus in five stages, each over all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, jaccard_join, line_dedup, packing, store, toxicity
from tessera.llm.queries import tokenizer_path


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents rated toxic go. Null and empty texts aren't toxic and stay, as do rows that repeat; each row
    is rated by its own text. An empty table stays empty; without labels of both classes all stay."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that 10 documents or more hold go; n_chars follows the text. Null texts stay null, and rows that
    repeat an id and a text count as one document but all stay. An empty table stays empty."""
    found = line_dedup.dedup_lines(docs.select("*", F.struct(F.col("text").isNull().alias("absent")).alias(mark := unused(docs, "mark"))), most=10, least_chars=1)
    text = F.when(~F.col(f"doc.`{mark}`.absent"), F.col("kept_text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def unused(docs: DataFrame, name: str) -> str:
    """`name`, with underscores in front until the table has no such column."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays, once if its row repeats. Texts
    without words (null, empty) and rows without an id all stay. An empty table stays empty."""
    return jaccard_join.keep_one(docs, threshold=0.8, n=5, recall=0.9999)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go: what is left around a cut passage still gives its
    item away. Null and empty texts stay, as do rows that repeat. An empty table stays empty."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens. A null or empty text is its end id alone;
    rows that repeat have pieces of their own. An empty table stays empty."""
    return packing.pack_documents(docs, tokenizer_path(), end_id=2, capacity=4096)


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_repeated_lines),
    ("jaccard_join", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("packing", pack_sequences),
]

#: Ordinal regression, MinHash and packing aren't SQL; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage made on its way is dropped once its result is a table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
