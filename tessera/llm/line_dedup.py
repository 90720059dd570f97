"""Line deduplication over levelled sorted runs of line hashes; DataFrame functions only.

A run is a table of (h1, h2, n_docs) sorted by the 128-bit hash of a line's key, with the
number of documents that hold the key. A batch counts its keys, anti-joins the keys that the
runs already know to be repeated, and adds the rest as a run of its own on level 0. When a
level has `fanout` runs they are merged (a sum by hash) into one run of the next level, and
keys that reach the limit go over to the runs of repeated keys.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased. Null
and empty texts are one empty line. Keys shorter than `least_chars` are never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import store

_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "".join(map(chr, range(65, 91)))


def line_key(line: Column) -> Column:
    """The key of a line; pure ASCII lines take the short way, `lower` would change other letters too."""
    bare = F.trim(line, F.lit(_SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The levels of runs. `most` is the number of documents from which on a key is repeated."""

    def __init__(self, spark: SparkSession, most: int = 10, fanout: int = 2):
        self.spark, self.most, self.fanout = spark, most, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.repeated: list[DataFrame] = []

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        """A run: a table in buckets of (h1, h2), a file a bucket, each sorted. Rows that are grouped or joined by the keys lie in
        these buckets already, so writing them shuffles nothing."""
        return store.written_sorted(df, name, self.buckets, "h1", "h2")

    def _union(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out

    def add(self, keys: DataFrame) -> None:
        """Add a batch of (h1, h2, n_docs) rows, one a key. Keys known as repeated go: the batch is merged with each such run."""
        with store.sorted_reads(self.spark):
            for known in self.repeated:
                keys = keys.join(known.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
            self._place(self._write(keys, "run"), 0)

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The keys of a batch that no run holds: what a keep-first deduplication lets through, before `add`."""
        for run in [*(r for level in self.levels for r in level), *self.repeated]:
            keys = keys.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        return keys

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self._merge(self.levels[level]), []
            self._place(self._write(merged.filter(F.col("n_docs") < self.most), "run"), level + 1)
            self.repeated.append(self._write(merged.filter(F.col("n_docs") >= self.most), "repeated"))

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        """One run of several: a merge join of each with what was merged before, without a shuffle or a sort."""
        out = runs[0].select("h1", "h2", "n_docs")
        for run in runs[1:]:
            more = run.select("h1", "h2", F.col("n_docs").alias("more")).hint("merge")
            out = out.join(more, ["h1", "h2"], "full").select("h1", "h2", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"))
        return out

    def all_repeated(self) -> DataFrame:
        """(h1, h2) of all keys that `most` documents or more hold: a last compaction over every level.

        A key of `repeated` was anti-joined from later batches only, so its earlier counts are whole there.
        """
        left = [r for level in self.levels for r in level]
        parts = [r.select("h1", "h2") for r in self.repeated]
        if left:
            parts.append(self._merge(left).filter(F.col("n_docs") >= self.most).select("h1", "h2"))
        return self._union(parts).distinct()


def _hashed(rows: DataFrame, least_chars: int) -> DataFrame:
    """(row, pos, h1, h2): a row a line that is long enough, by its 128-bit hash."""
    lines = F.transform(split_lines(F.col("text")), lambda x: line_key(x))
    each = rows.select("row", F.posexplode(lines).alias("pos", "key")).filter(F.length("key") >= least_chars)
    return each.select("row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def dedup_lines(docs: DataFrame, most: int = 10, least_chars: int = 1, batches: int = 4, fanout: int = 2) -> DataFrame:
    """A row for each row of `docs` (doc_id, text and any other columns): `doc` (a struct of its
    columns but text), n_lines (before), n_dropped and kept_text (the lines that stay, joined by \\n).

    A document is an id with a text: rows that repeat both count once, rows without an id by
    their text. An empty table stays empty.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64(text).cast("string"))
    seen = _hashed(docs.select(row.alias("row"), text.alias("text")), least_chars)
    # Grouping by line and document deals a very common line over all tasks.
    by_line = seen.groupBy("h1", "h2", "row").agg(F.collect_set("pos").alias("at"))
    once = store.written(by_line.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int")), "lines")
    runs = LineRuns(spark, most, fanout)
    for k in range(batches):
        runs.add(once.filter(F.col("batch") == k).groupBy("h1", "h2").agg(F.count("*").alias("n_docs")))
    hits = once.select("row", "h1", "h2", "at").join(runs.all_repeated(), ["h1", "h2"], "left_semi")
    drop = hits.groupBy("row").agg(F.flatten(F.collect_list("at")).alias("drop"))
    # The lines are split below the join, so that the function over positions reads a column.
    whole = docs.select(row.alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"), split_lines(F.col("text").cast("string")).alias("lines"))
    joined = whole.join(drop, "row", "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<int>")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    return joined.select(F.col("rest").alias("doc"), F.size("lines").cast("long").alias("n_lines"), F.size("drop").cast("long").alias("n_dropped"), kept.alias("kept_text"))
