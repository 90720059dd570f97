"""Conversations to turns, windows and whole-conversation chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import text as T

#: Window size and stride in turns, least length of a chunk.
SIZE, STRIDE, LEAST = 5, 3, 40
ROLES = {"user": "human", "human": "human", "assistant": "agent", "agent": "agent", "system": "system"}


def normalise_role(role: Column) -> Column:
    """human, agent or system; null for any other role."""
    return F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))[role]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq from 1, role, text) of known roles, from (conv_id, turn from 0, role, text)."""
    return conversations.select("conv_id", (F.col("turn") + 1).cast("int").alias("seq"), normalise_role(F.col("role")).alias("role"), "text").filter("role is not null")


def prose(turns: DataFrame) -> DataFrame:
    """Turns with text, numbered from 0 in each conversation (`idx`), with the conversation's count (`n`)."""
    w = W.partitionBy("conv_id")
    return turns.filter(F.trim("text") != "").withColumn("idx", F.row_number().over(w.orderBy("seq")) - 1).withColumn("n", F.count("*").over(w))


def formatted() -> Column:
    return F.format_string("[%d] %s: %s", F.col("seq"), F.initcap("role"), F.trim("text"))


def windows(turns: DataFrame, size: int = SIZE, stride: int = STRIDE, heading: Column | None = None) -> DataFrame:
    """Overlapping windows over prose turns: starts at every stride, and one that ends at the last turn.

    Each turn gathers itself and the next turns of its conversation by one window pass; only
    starts are kept, so no join is needed. (conv_id, granularity, seq_start, seq_end, content)
    """
    rows = prose(turns).withColumn("size", F.least(F.lit(size), F.col("n")))
    ahead = W.partitionBy("conv_id").orderBy("seq").rowsBetween(0, size - 1)
    got = rows.withColumn("lines", F.collect_list(formatted()).over(ahead)).withColumn("seq_end", F.max("seq").over(ahead))
    starts = (F.col("idx") <= F.col("n") - F.col("size")) & ((F.col("idx") % stride == 0) | (F.col("idx") == F.col("n") - F.col("size")))
    body = F.array_join("lines", "\n\n")
    content = T.clip(body if heading is None else F.concat(heading, F.lit("\n\n"), body))
    out = got.filter(starts).select("conv_id", F.lit("window").alias("granularity"), F.col("seq").alias("seq_start"), "seq_end", content.alias("content"))
    return out.filter(F.length("content") >= LEAST)


def sessions(turns: DataFrame, heading: Column | None = None) -> DataFrame:
    """All prose of a conversation as one clipped chunk.

    A running length is taken first, so that of a long conversation only the lines before the cut are gathered."""
    rows = turns.filter(F.trim("text") != "").withColumn("line", formatted())
    before = F.sum(F.length("line") + 2).over(W.partitionBy("conv_id").orderBy("seq", "line").rowsBetween(W.unboundedPreceding, -1))
    # Two characters of a separator stand before a line; what starts behind the cut can't be in the clip.
    first = F.when(F.coalesce(before, F.lit(0)) <= T.CLIP + 2, F.struct("seq", "line"))
    lines = F.transform(F.array_sort(F.collect_list("first")), lambda x: x["line"])
    got = rows.withColumn("first", first).groupBy("conv_id").agg(F.min("seq").alias("seq_start"), F.max("seq").alias("seq_end"), F.array_join(lines, "\n\n").alias("body"))
    content = T.clip(F.col("body") if heading is None else F.concat(heading, F.lit("\n\n"), F.col("body")))
    return got.select("conv_id", F.lit("session").alias("granularity"), "seq_start", "seq_end", content.alias("content")).filter(F.length("content") >= LEAST)


def chunks(turns: DataFrame) -> DataFrame:
    """Window and session chunks with an id and the hash that says whether a stored chunk is still the same."""
    rows = windows(turns).unionByName(sessions(turns))
    key = F.concat_ws(":", F.col("conv_id"), "granularity", "seq_start", "seq_end")
    return rows.select(key.alias("id"), "*", F.sha2("content", 256).alias("content_sha256"), T.cjk_runs(F.col("content")).alias("content_cjk"))


def around(turns: DataFrame, seq: int, radius: int = 10) -> DataFrame:
    if radius < 0:
        raise ValueError("radius must not be negative")
    return turns.filter(F.col("seq").between(seq - radius, seq + radius))


def tail(turns: DataFrame, limit: int) -> DataFrame:
    """The last turns of each conversation; all of them if the limit is 0 or less."""
    if limit <= 0:
        return turns
    w = W.partitionBy("conv_id").orderBy(F.desc("seq"))
    return turns.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= limit).drop("_back")


def overlay(turns: DataFrame, translated: DataFrame) -> DataFrame:
    """Turns whose text is replaced by (conv_id, seq, locale, text) rows; a row a turn and locale, others keep their text."""
    locales = translated.select("conv_id", "locale").distinct()
    named = translated.select("conv_id", "seq", "locale", F.col("text").alias("other"))
    joined = turns.join(locales, "conv_id").join(named, ["conv_id", "seq", "locale"], "left")
    return joined.select("conv_id", "locale", "seq", "role", F.coalesce("other", "text").alias("text"))


def titles(turns: DataFrame, hint: Column | None = None) -> DataFrame:
    """(conv_id, title) by the opening prompts of each conversation: a title needs the first two, so no more are gathered."""
    lines = turns.filter("role = 'human'").select("conv_id", "seq", T.prompt_line(F.col("text")).alias("line")).filter("line is not null")
    opening = lines.withColumn("_k", F.row_number().over(W.partitionBy("conv_id").orderBy("seq", "line"))).filter("_k <= 2").select("conv_id", F.struct("seq", "line").alias("p"))
    every = turns.select("conv_id").distinct().withColumn("p", F.lit(None).cast("struct<seq:int,line:string>"))
    got = every.unionByName(opening).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["line"]).alias("prompts"))
    return got.select("conv_id", T.conversation_title(F.lit(None).cast("string") if hint is None else hint, F.col("prompts"), F.col("conv_id").cast("string")).alias("title"))


def listing_copy(turns: DataFrame, most: int = 280) -> DataFrame:
    """The first prose of each conversation, cut for a listing."""
    return turns.filter(F.trim("text") != "").groupBy("conv_id").agg(F.substring(F.min_by("text", "seq"), 1, most).alias("description"))


def cjk_prose(turns: DataFrame) -> DataFrame:
    """Turns whose text holds a CJK ideograph."""
    return turns.filter(F.rlike("text", F.lit("[\u3400-\u9fff]")))


#: What a document's missing fields are read as.
DOCUMENT_DEFAULTS = {"type": "text", "role": "agent", "host": "unknown"}


def to_document(fields: list[str]) -> Column:
    """A row's fields as JSON; those that are null are left out."""
    return F.to_json(F.struct(*fields))


def from_document(json: Column, schema: str) -> Column:
    """The fields of a document, defaults in place of missing ones."""
    names = [x.split()[0] for x in schema.split(", ")]
    read = F.from_json(json, schema)
    return F.struct(*(F.coalesce(read[n], F.lit(DOCUMENT_DEFAULTS[n])).alias(n) if n in DOCUMENT_DEFAULTS else read[n].alias(n) for n in names))
