"""The chunk index of conversations, kept up to date by hashes, and the knowledge index and graph synchronised from files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import batching, chunking, graph, merging


def update_index(turns: DataFrame, stored: DataFrame, embed_fn: Callable[[list[str]], list[list[float]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """The chunk table after all conversations are indexed, and the actions by chunk.

    `stored` is the old table (id, content_sha256, embedding and the chunk columns). Only chunks whose text
    changed or that lack a vector are embedded; the others keep their vectors; chunks that are gone are dropped.
    Without a function new chunks have no vector yet.
    """
    wanted = chunking.chunks(turns)
    old = stored.select("id", "content_sha256", "embedding", F.col("embedding").isNotNull().alias("has_vector"))
    actions = merging.diff_by_key(wanted, old, ["id"], has_vector="has_vector" if embed_fn else None)
    kept = old.select("id", F.col("content_sha256").alias("_sha"), F.col("embedding").alias("_old"))
    same = F.col("_sha").eqNullSafe(F.col("content_sha256"))
    rows = wanted.join(kept, "id", "left").withColumn("_keep", F.when(same, F.col("_old"))).drop("_sha", "_old")
    if embed_fn is None:
        return rows.withColumnRenamed("_keep", "embedding"), actions
    fresh = batching.embed(rows.filter("_keep is null"), "id", "content", embed_fn).withColumnRenamed("embedding", "_new")
    return rows.join(fresh, "id", "left").withColumn("embedding", F.coalesce("_keep", "_new")).drop("_keep", "_new"), actions


def index_stats(actions: DataFrame) -> DataFrame:
    """One row: chunks, embedded, unchanged and deleted."""
    n = lambda *kinds: F.count_if(F.col("action").isin(*kinds))
    return actions.agg(n("insert", "update", "embed", "unchanged").alias("chunks"), n("insert", "update", "embed").alias("embedded"), n("unchanged").alias("unchanged"), n("delete").alias("deleted"))


def compact_vectors(rows: DataFrame, text: str = "embedding_json", vector: str = "embedding") -> DataFrame:
    """Vectors read from their JSON text where there is none yet; `unreadable` marks texts that can't be read."""
    from tessera.functions.text import embedding_of_json

    parsed = embedding_of_json(F.col(text))
    return rows.withColumn("unreadable", F.col(vector).isNull() & F.col(text).isNotNull() & parsed.isNull()).withColumn(vector, F.coalesce(F.col(vector), parsed))


def normalised(rows: DataFrame, vector: str = "embedding", width: int | None = None) -> DataFrame:
    """Unit vectors, ready to be scored by a dot product; rows of another width are dropped."""
    kept = rows.filter(F.size(vector) == width) if width else rows.filter(F.size(vector) > 0)
    return kept.withColumn(vector, V.unit(F.col(vector)))


def render(turns: DataFrame, markdown: bool = False) -> DataFrame:
    """Each conversation as text: a line a turn, or Markdown with a heading a turn."""
    role = F.initcap("role")
    line = F.concat(F.lit("## "), role, F.lit(" · "), F.col("seq").cast("string"), F.lit("\n\n"), F.trim("text")) if markdown else F.concat(F.lit("["), F.col("seq").cast("string"), F.lit("] "), role, F.lit(": "), F.trim("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"])
    return turns.groupBy("conv_id").agg(F.array_join(lines, "\n\n").alias("body"))


#: Locales that titles may have, and locales that turns may have.
TITLE_LOCALES, TURN_LOCALES = ("original", "en", "es"), ("en", "es")


def normalise_presentation(title: Column, description: Column, turns: Column) -> Column:
    """A presentation of maps by locale: white space collapsed, unknown locales and blank texts go; null if nothing is left."""

    def texts(m: Column) -> Column:
        return F.map_filter(F.transform_values(m, lambda k, v: F.trim(F.regexp_replace(v, r"(?U)\s+", " "))), lambda k, v: k.isin(*TITLE_LOCALES) & (v != ""))

    t, d, b = texts(title), texts(description), F.map_filter(turns, lambda k, v: k.isin(*TURN_LOCALES) & (F.size(v) > 0))
    some = (F.coalesce(F.size(t), F.lit(0)) > 0) | (F.coalesce(F.size(d), F.lit(0)) > 0) | (F.coalesce(F.size(b), F.lit(0)) > 0)
    return F.when(some, F.struct(t.alias("title"), d.alias("description"), b.alias("turns")))


def path_problems(items: DataFrame, files: DataFrame) -> DataFrame:
    """(node_id, path): Markdown paths of items (node_id, path) that no file has; web addresses are left alone."""
    named = items.filter(F.endswith("path", F.lit(".md")) & ~F.startswith("path", F.lit("http"))).select("node_id", "path")
    return named.join(files.select("path"), "path", "left_anti").select("node_id", "path")


def sync_graph(items: DataFrame, listed: DataFrame, docs: DataFrame, history: DataFrame, edges: DataFrame, now: Column) -> dict[str, DataFrame]:
    """One load of the graph: curated nodes and edges, stubs for documents without a node, structural edges, back-links, coverage.

    Returns the new `history` of nodes and `edges`, the linked `docs` and `coverage`; nothing is written, so looking at
    them is a dry run. Stubs at a curated path close by themselves, as no stub is wanted there.
    """
    curated = graph.node_rows(items).select("node_id", "node_type", "graph", "title", "attributes", "source_path", "content_hash")
    stubs = graph.stub_nodes(graph.unlinked_docs(docs, curated))
    nodes = curated.unionByName(stubs.join(curated.select("node_id"), "node_id", "left_anti"))
    loaded = graph.edge_rows(items).unionByName(graph.listed_edges(listed))
    structural = graph.structural_edges(nodes.select("node_id", "source_path"), nodes).select("src_id", "dst_id", "edge_type")
    after = graph.replace_edges(graph.replace_edges(edges, loaded, structural=False), structural, structural=True)
    linked = graph.backlink(docs, nodes)
    return {"history": merging.scd2_merge(history, nodes, "node_id", now), "edges": after, "docs": linked, "coverage": graph.coverage(linked, nodes)}
