"""Host transcripts (JSON lines, two layouts) as turns with redacted blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import text as T
from tessera.operators.chunking import normalise_role

_BLOCKS = "array<struct<type:string,text:string,name:string,input:string>>"


def files(spark: SparkSession, path: str, suffix: str = "*.jsonl") -> DataFrame:
    """(path, modified, value): whole files, newest first when listed; line order is kept by reading them whole."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), "value")


def discovered(found: DataFrame, slug: str) -> DataFrame:
    """Files of a checkout: their folder is its slug, or ends with it; newest first."""
    folder = F.element_at(F.split("path", "/"), -2)
    return found.filter((folder == slug) | F.endswith(folder, F.lit(f"-{slug}"))).orderBy(F.desc("modified"), "path")


def _lines(found: DataFrame) -> DataFrame:
    """(path, line, raw) of whole files (`files`), or of lines that a data source gives with their offset (`lines.lines`)."""
    if "raw" in found.columns:
        each = found.filter("error is null").select("path", F.col("offset").alias("line"), "raw")
        return each.filter((F.trim("raw") != "") & F.try_parse_json("raw").isNotNull())
    each = found.select("path", F.posexplode(F.split("value", "\n")).alias("line", "raw"))
    return each.filter(F.trim("raw") != "").withColumn("ok", F.try_parse_json("raw").isNotNull()).filter("ok")


def _inputs(raw):
    """(key, value) pairs of a tool's input in document order."""
    keys = F.json_object_keys(raw)
    values = F.from_json(raw, "map<string,string>")
    return F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.struct(k.alias("key"), F.element_at(values, k).alias("value")))


def _turns(lines: DataFrame, blocks, keep_empty: bool) -> DataFrame:
    text = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"])
    tools = F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: F.struct(b["name"].alias("tool_name"), T.summarise_tool_input(_inputs(b["input"])).alias("tool_input")))
    safe = T.redact(F.array_join(text, "\n\n"))
    rows = lines.select("path", "line", "role", safe.alias("safe"), tools.alias("tools"))
    if not keep_empty:
        rows = rows.filter((F.trim("safe.text") != "") | (F.size("tools") > 0))
    seq = F.row_number().over(W.partitionBy("path").orderBy("line"))
    return rows.select("path", seq.alias("seq"), "role", F.col("safe.text").alias("text"), "tools", F.col("safe.hits").alias("redactions"))


def read_nested(found: DataFrame) -> DataFrame:
    """Layout A: `role` beside `message.content` blocks. Unknown roles and malformed lines are skipped; a query wrapper is removed."""
    lines = _lines(found).withColumn("role", normalise_role(F.get_json_object("raw", "$.role"))).filter("role is not null")
    blocks = F.coalesce(F.from_json(F.get_json_object("raw", "$.message.content"), _BLOCKS), F.array().cast(_BLOCKS))
    bare = F.transform(blocks, lambda b: F.struct(b["type"].alias("type"), F.regexp_replace(b["text"], r"(?s)^\s*<user_query>\s*(.*?)\s*</user_query>\s*$", "$1").alias("text"), b["name"].alias("name"), b["input"].alias("input")))
    return _turns(lines, bare, keep_empty=True)


def read_typed(found: DataFrame) -> DataFrame:
    """Layout B: lines by `type`; side chains and meta lines are skipped, a string is one text block, and turns
    without text or tools take no number."""
    j = lambda p: F.get_json_object("raw", p)
    lines = _lines(found).withColumn("role", normalise_role(j("$.type")))
    lines = lines.filter((F.col("role").isNotNull()) & (F.coalesce(j("$.isSidechain"), F.lit("false")) != "true") & (F.coalesce(j("$.isMeta"), F.lit("false")) != "true"))
    content = j("$.message.content")
    listed = F.from_json(content, _BLOCKS)
    plain = F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("input")))
    blocks = F.when(F.startswith(F.ltrim(content), F.lit("[")), listed).otherwise(plain).cast(_BLOCKS)
    return _turns(lines, F.coalesce(blocks, F.array().cast(_BLOCKS)), keep_empty=False)


def title_hints(found: DataFrame) -> DataFrame:
    """(path, title_hint): the last title that the host gave."""
    lines = _lines(found).filter(F.get_json_object("raw", "$.type") == "ai-title")
    return lines.groupBy("path").agg(F.max_by(F.get_json_object("raw", "$.aiTitle"), "line").alias("title_hint"))


#: Readers by host; a host of one's own is one more entry.
READERS = {"nested": read_nested, "typed": read_typed}
