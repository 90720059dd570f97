"""Sharding along a Hilbert curve; DataFrame functions only.

Several metadata dimensions (language, source, size) are quantised to a few bits at quantiles,
in an order-preserving way; strings are ranked whole, by the order of their bytes. Rows are
ordered by the Hilbert index of their cell, so rows that are near in all dimensions come near
each other, and the order is cut into runs of equal row counts: a file then covers a narrow
range of every dimension and can be pruned by any.

Ranks are global without a global sort. Cells are at most 2^(bits * dimensions). A cell is divided
by a hash of the text into parts of a bounded number of rows, so a hot source needs no task of its
own; a part that copies of one text fill is divided again by a hash of the document's id, and what
rows alike in both fill, by the rows' places in the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm import store


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """The Hilbert index of non-negative whole axes below 2^bits.

    The bits of the axes are transformed in place by exchanges and inversions from the highest
    bit down, Gray-decoded and interleaved. Steps run in a fold over (bit, axis), so the
    expression does not grow with them.
    """
    n = len(axes)
    point = F.array(*(a.cast("long") for a in axes))
    steps = F.array(*(F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)))

    def undo(x: Column, s: Column) -> Column:
        q, i = s["q"], s["i"]
        mask = q - 1
        here = F.get(x, i)
        swap = (F.get(x, F.lit(0)).bitwiseXOR(here)).bitwiseAND(mask)
        inverted = here.bitwiseAND(q) != 0
        return F.transform(
            x,
            lambda v, j: F.when(inverted, F.when(j == 0, v.bitwiseXOR(mask)).otherwise(v)).otherwise(
                F.when((i > 0) & ((j == 0) | (j == i)), v.bitwiseXOR(swap)).otherwise(v)
            ),
        )

    moved = F.aggregate(steps, point, undo) if bits > 1 else point
    # Gray code: each axis takes the exclusive or of all before it and itself.
    gray = F.aggregate(moved, F.array().cast("array<long>"), lambda acc, v: F.concat(acc, F.array(v.bitwiseXOR(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))))))
    qs = F.array(*(F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1))) if bits > 1 else F.array().cast("array<long>")

    def fix(g: Column) -> Column:
        flip = F.aggregate(qs, F.lit(0).cast("long"), lambda t, q: F.when(F.get(g, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return F.transform(g, lambda v: v.bitwiseXOR(flip))

    order = F.array(*(F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)))
    fixed = fix(gray)
    return F.aggregate(
        order,
        F.struct(F.lit(0).cast("long").alias("h"), fixed.alias("x")),
        lambda a, s: F.struct((a["h"] * 2 + F.when(F.get(a["x"], s["i"]).bitwiseAND(s["q"]) != 0, 1).otherwise(0)).alias("h"), a["x"].alias("x")),
        lambda a: a["h"],
    )


def string_cuts(df: DataFrame, dims: dict[str, Column], bits: int) -> dict[str, list[tuple[int, str]]]:
    """For each dimension the codes 0 .. 2^bits - 1 that occur and the least string of each; null counts as empty.

    Distinct strings are counted, sorted in range partitions, and coded by the share of rows below them.
    The driver gets at most 2^bits strings a dimension.
    """
    if not dims:
        return {}
    kinds = F.explode(F.array(*(F.struct(F.lit(name).alias("dim"), F.coalesce(c.cast("string"), F.lit("")).alias("value")) for name, c in dims.items()))).alias("k")
    counted = df.select(kinds).groupBy("k.dim", "k.value").agg(F.count("*").alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = store.written(counted.repartitionByRange(parts, "dim", "value").withColumn("part", F.spark_partition_id()), "shard-values")
    sums = dealt.groupBy("dim", "part").agg(F.sum("n").alias("own"))
    upto = W.partitionBy("dim").orderBy("part")  # a row a dimension and partition
    sums = sums.select("dim", "part", (F.sum("own").over(upto) - F.col("own")).alias("before"), F.sum("own").over(W.partitionBy("dim")).alias("total"))
    below = F.sum("n").over(W.partitionBy("dim", "part").orderBy("value")) - F.col("n") + F.col("before")
    code = F.floor(below * (1 << bits) / F.col("total")).cast("int")
    coded = dealt.join(sums, ["dim", "part"]).withColumn("code", code).groupBy("dim", "code").agg(F.min("value").alias("least"))
    out: dict[str, list[tuple[int, str]]] = {name: [] for name in dims}
    for r in coded.orderBy("dim", "code").collect():
        out[r["dim"]].append((r["code"], r["least"]))
    return out


def quantise(df: DataFrame, numbers: dict[str, Column], strings: dict[str, Column], bits: int, accuracy: int = 10_000) -> dict[str, Column]:
    """Codes 0 .. 2^bits - 1 of each dimension: of a number, how many of its quantile cuts lie below it; of a
    string, the code of its range of strings. The cuts are a few values whatever the input's size."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = df.agg(*(F.percentile_approx(c, shares, accuracy).alias(name) for name, c in numbers.items())).first() if numbers else {}
    out = {}
    for name, value in numbers.items():
        edges = F.array(*(F.lit(float(e)) for e in sorted(set(cuts[name] or []))), F.lit(float("inf")))
        out[name] = F.size(F.filter(edges, lambda e, value=value: e < value))
    for name, listed in string_cuts(df, strings, bits).items():
        value = F.coalesce(strings[name].cast("string"), F.lit(""))
        steps = [F.when(value >= least, code) for code, least in reversed(listed)]
        out[name] = F.coalesce(*steps, F.lit(0))
    return out


def place(docs: DataFrame, shards: int = 16, bits: int = 4, broadcast_rows: int = 100_000, least_rows: int = 200, whole: bool = False) -> DataFrame:
    """size (UTF-8 bytes plus 1), text_crc32, hilbert, shard and slot of every row of `docs` (doc_id, text, lang,
    source), with doc_id, or with the whole row as a struct `doc`.

    Law `rows`: the shards' row counts are at most one apart. Within a cell rows are ordered by a hash of
    the text, then doc_id, but for parts that copies of one text fill, which are ordered by a hash of
    doc_id first. Rows that agree in text and doc_id are alike and take their places in any order. Null
    texts count as empty, null dimensions as the least value; rows without an id, and rows that repeat,
    have places of their own; an empty table stays empty.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.struct("*").alias("doc") if whole else F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("doc")
    rows = docs.select(
        own,
        F.col("doc_id").cast("long").alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.col("lang").alias("lang_key"),
        F.col("source").alias("source_key"),
    )
    rows = store.written(rows, "shard-rows")
    total = rows.count()
    # Parts are small against a task's share, so that no task gets far more than another, within bounds (`least_rows` and 100,000).
    rows_per_part = min(max(total // (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))), least_rows), 100_000)
    numbers, strings = {"size": F.log2("size")}, {"lang": F.col("lang_key"), "source": F.col("source_key")}
    codes = quantise(rows, numbers, strings, bits)
    axes = ["q_lang", "q_source", "q_size"]
    carried = ["doc", "id", "size", "text_crc32", "h"]
    placed = rows.select(*carried, *(c.alias(f"q_{k}") for k, c in codes.items()))
    cells = placed.groupBy(*axes).agg(F.count("*").alias("n")).withColumn("hilbert", hilbert_index([F.col(a) for a in axes], bits))
    # At most 2^(bits * dimensions) rows, so the table is small whatever the input's size.
    cells = cells.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("n") / rows_per_part)).cast("long"))
    cells = store.written(cells, "shard-cells")
    assert len(axes) * bits <= 14, "the table of cells is broadcast"
    dealt = placed.join(F.broadcast(cells.select(*axes, "hilbert", "parts")), axes)
    # The hash's range is cut evenly, so parts keep the order by hash and equal texts stay together.
    part = F.least(F.floor((F.shiftrightunsigned("h", 1).cast("double") / F.lit(float(1 << 63))) * F.col("parts")).cast("long"), F.col("parts") - 1)
    dealt = dealt.select(*carried, "hilbert", part.alias("part"))

    def cut(rows_: DataFrame, by: list[str], name: str, key: Column) -> DataFrame:
        """Add `name`: 0, or in groups `by` of over twice `rows_per_part` rows a number from `key`."""
        crowded = rows_.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > 2 * rows_per_part)
        crowded = store.written(crowded.select(*by, F.ceil(F.col("n") / rows_per_part).alias("cuts")), "shard-crowded")
        # A short list goes to the rows; beyond the bound both sides are shuffled.
        if crowded.count() <= broadcast_rows:
            crowded = F.broadcast(crowded)
        number = F.coalesce(F.pmod(key, F.col("cuts")), F.lit(0)).cast("long")
        return rows_.join(crowded, by, "left").withColumn(name, number).drop("cuts")

    dealt = store.written(cut(dealt, ["hilbert", "part"], "sub", F.xxhash64("id", "h")), "shard-dealt")
    keys = ["hilbert", "part", "sub", "like"]
    dealt = cut(dealt, keys[:3], "like", F.xxhash64(F.monotonically_increasing_id()))
    dealt = store.written(dealt, "shard-parts")
    counts = dealt.groupBy(*keys).agg(F.count("*").alias("n"))
    in_cell = F.sum("n").over(W.partitionBy("hilbert").orderBy(*keys[1:])) - F.col("n")
    before = cells.select("hilbert", (F.sum("n").over(W.orderBy("hilbert")) - F.col("n")).alias("before"))
    starts = counts.withColumn("in_cell", in_cell).join(before, "hilbert").select(*keys, (F.col("before") + F.col("in_cell")).alias("start"))
    order = W.partitionBy(*keys).orderBy("h", "id", "size")
    ranked = dealt.withColumn("k", F.row_number().over(order)).join(starts, keys)
    rank = F.col("start") + F.col("k") - 1
    number = F.expr(f"(start + k - 1) * {shards} div {max(total, 1)}")
    out = ranked.select("doc", "size", "text_crc32", "hilbert", rank.alias("rank"), number.cast("int").alias("shard"))
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return out.select("doc" if whole else "doc.doc_id", "size", "text_crc32", "hilbert", "shard", (F.col("rank") - first).alias("slot"))


def shard(docs: DataFrame, shards: int = 16, bits: int = 4, broadcast_rows: int = 100_000, least_rows: int = 200) -> DataFrame:
    """doc_id, size, text_crc32, hilbert, shard and slot of every row; see `place`."""
    return place(docs, shards, bits, broadcast_rows, least_rows)


def write_shards(docs: DataFrame, path: str, shards: int = 16, rows_per_file: int = 100_000, by: str = "shard") -> None:
    """Write whole rows as one folder a shard (`by`=number), each sorted along the curve, for pruned reads.

    Every row is written once, also those without an id or that repeat. If the table has a column called
    `by`, the folders' name gets underscores in front until it is new.
    """
    while by in docs.columns:
        by = f"_{by}"
    placed = place(docs, shards, whole=True)
    run = F.floor(F.col("slot") / rows_per_file)
    dealt = placed.withColumn("run", run).repartition("shard", "run").sortWithinPartitions("shard", "slot")
    dealt.select("doc.*", F.col("shard").alias(by)).write.partitionBy(by).parquet(path)
