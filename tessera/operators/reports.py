"""Reports: titles joined to vectors, totals of a sync, and files that can't be loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def with_titles(vectors: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Vectors (key, title, ...) with their document's title, where there is one, in place of their own."""
    titles = documents.select(key, F.col("title").alias("_title"))
    return vectors.join(titles, key, "left").withColumn("title", F.coalesce("_title", "title")).drop("_title")


def sync_report(rows: DataFrame, content: str = "content", sha: str = "content_sha256") -> DataFrame:
    """One row of totals of what was synchronised: rows, rows without content, characters, and distinct contents."""
    empty = F.coalesce(F.trim(content) == "", F.lit(True))
    return rows.agg(F.count("*").alias("n"), F.count_if(empty).alias("n_without_content"), F.coalesce(F.sum(F.length(content)), F.lit(0)).alias("chars"), F.count_distinct(sha).alias("n_contents"))


def loaded(files: DataFrame, text: str = "text") -> DataFrame:
    """Graph files (path, text) with `format` (nodes, documents or none), `total_nodes` and `error` (null if it can be read)."""
    json = F.try_parse_json(text)
    count = lambda name: F.size(F.from_json(F.get_json_object(text, f"$.{name}"), "array<string>"))
    kind = F.when(F.get_json_object(text, "$.nodes").isNotNull(), "nodes").when(F.get_json_object(text, "$.documents").isNotNull(), "documents")
    error = F.when(json.isNull(), "bad JSON").when(kind.isNull(), "unknown format")
    n = F.when(kind == "nodes", count("nodes")).when(kind == "documents", count("documents"))
    return files.select("path", F.when(error.isNull(), kind).alias("format"), F.when(error.isNull(), F.coalesce(n, F.lit(0))).otherwise(0).alias("total_nodes"), error.alias("error"))


def load_summary(rows: DataFrame) -> DataFrame:
    """Files and nodes by format, and whether none of that format failed."""
    return rows.groupBy(F.coalesce("format", F.lit("-")).alias("format")).agg(F.count("*").alias("files"), F.sum("total_nodes").alias("total_nodes"), (F.count("error") == 0).alias("passed"))


def listing_lines(sessions: DataFrame, now: Column) -> DataFrame:
    """A line a session for lists: id, lane, status and whole idle hours."""
    idle = F.timestamp_diff("HOUR", F.col("updated_at"), now)
    line = F.concat_ws(" · ", F.concat(F.lit("#"), F.col("session_id")), F.coalesce("lane", F.lit("default")), "status", F.concat(idle, F.lit(" h")))
    return sessions.select("session_id", line.alias("line"))


def resume_text(resumed: DataFrame) -> DataFrame:
    """(session_id, body): what to read before a session goes on, of `sessions.resume`'s rows with the checkpoint's
    next_action, decisions and whether it was `auto`. Parts that a session lacks have no line."""
    said = lambda label, c: F.concat(F.lit(f"{label}: "), c.cast("string"))
    point = F.when(F.col("checkpoint_id").isNull(), "no checkpoint yet").otherwise(F.concat(F.lit("checkpoint: "), F.col("checkpointed_at").cast("string"), F.when(F.col("auto"), " (automatic)").otherwise("")))
    action = F.concat(F.lit("next action"), F.when(F.col("auto"), " (carried forward)").otherwise(""), F.lit(": "), F.col("next_action"))
    chosen = F.when(F.size("decisions") > 0, F.concat(F.lit("decisions:\n  - "), F.array_join("decisions", "\n  - ")))
    head = F.concat(F.lit("session: "), F.col("session_id").cast("string"), F.lit(" ("), F.col("status"), F.lit(")"))
    return resumed.select("session_id", F.concat_ws("\n", head, said("workspace", F.col("workspace_key")), said("lane", F.col("lane")), said("title", F.col("title")), said("updated", F.col("updated_at")), point, action, chosen).alias("body"))


def lane_lines(lanes: DataFrame) -> DataFrame:
    """A line each of `sessions.other_lanes`: lane, idle time, the id's start, title, and a mark if it is stale."""
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("(untitled)"))
    line = F.concat_ws("  ", "lane", F.concat(F.lit("idle "), T.idle_label(F.coalesce("idle_hours", F.lit(0)))), F.substring(F.col("session_id").cast("string"), 1, 8), title, F.when(F.col("stale"), "stale"))
    return lanes.select("session_id", line.alias("line"))


def tree_lines(trees: DataFrame) -> DataFrame:
    """(root, session_id, depth, line) of `sessions.tree` or `graph.lineage` rows: a line a session, two blanks a level."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), F.lit("- "), F.col("session_id").cast("string"), F.lit(" "), F.col("status"))
    return trees.select("root", "session_id", "depth", line.alias("line"))


def switch_lines(rows: DataFrame) -> DataFrame:
    """(session_id, line) of rows (session_id, situation, checkpoint_host, host): what to ask when another machine is
    or was at work; none for a session that goes on where it was."""
    hand = F.concat(F.lit("last checkpoint on "), F.col("checkpoint_host"), F.lit(", now on "), F.col("host"), F.lit(": go on with the same session, or fork?"))
    clash = F.concat(F.lit("another machine is at work here, this one is "), F.col("host"), F.lit(": take another lane, or take over?"))
    line = F.when(F.col("situation") == "handoff", hand).when(F.col("situation") == "contention", clash)
    return rows.select("session_id", line.alias("line")).filter("line is not null")
