"""Queries over the chunk index."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import batching, indexing
from tessera.plans import derive as D
from tessera.sources.tables import table


def _stored(spark, d):
    """An older index: some chunks are missing, changed, without a vector, or gone since."""
    c = D.chunks(spark, d)
    k = F.col("conv_id")
    old = c.filter(k % 5 != 1).select("id", F.when(k % 5 == 2, "old").otherwise(F.col("content_sha256")).alias("content_sha256"), F.when(k % 5 != 3, F.array(F.lit(1.0).cast("float"))).alias("embedding"))
    gone = c.filter(k % 5 == 4).select(F.concat(F.lit("gone:"), "id").alias("id"), "content_sha256", F.lit(None).cast("array<float>").alias("embedding"))
    return old.unionByName(gone)


def index_update(spark, d):
    table_, _ = indexing.update_index(D.turns(spark, d), _stored(spark, d), batching.hashing_embedder(8))
    return table_.select("id", F.size("embedding").alias("width"), (F.size("embedding") == 1).alias("kept"))


SQL_INDEX = f"""with {D.SQL_CHUNKS} select id, cast(case when conv_id % 5 in (0, 4) then 1 else 8 end as int) as width, conv_id % 5 in (0, 4) as kept from chunks"""


def index_stats(spark, d):
    _, actions = indexing.update_index(D.turns(spark, d), _stored(spark, d), batching.hashing_embedder(8))
    return indexing.index_stats(actions)


SQL_STATS = f"""with {D.SQL_CHUNKS} select count(*) as chunks, count(*) filter (conv_id % 5 not in (0, 4)) as embedded, count(*) filter (conv_id % 5 in (0, 4)) as unchanged, count(*) filter (conv_id % 5 = 4) as deleted from chunks"""


def render_text(spark, d):
    return indexing.render(D.turns(spark, d)).select("conv_id", F.sha2("body", 256).alias("body_sha256"))


SQL_RENDER = (
    f"with {D.SQL_TURNS} select conv_id, sha256(string_agg('[' || seq || '] ' || upper(substr(role, 1, 1)) || substr(role, 2) "
    f"|| ': ' || trim(text, ' '), chr(10) || chr(10) order by seq)) as body_sha256 from turns group by conv_id"
)


def compact_vectors(spark, d):
    v = table(spark, d, "embeddings")
    k = F.col("vec_id")
    rows = v.select("vec_id", F.when(k % 3 == 0, F.col("embedding")).alias("embedding"), F.when(k % 7 == 0, F.lit("[broken")).otherwise(F.to_json("embedding")).alias("embedding_json"))
    return indexing.compact_vectors(rows).select("vec_id", F.size("embedding").alias("width"), "unreadable")


SQL_COMPACT = (
    "select vec_id, cast(case when vec_id % 3 = 0 or vec_id % 7 <> 0 then len(embedding) end as int) as width, vec_id % 3 <> "
    "0 and vec_id % 7 = 0 as unreadable from embeddings"
)


def unit_vectors(spark, d):
    rows = indexing.normalised(table(spark, d, "embeddings"), width=64)
    from tessera.functions import vectors as V

    return rows.select("vec_id", F.round(V.norm(F.col("embedding")), 4).alias("norm"))


SQL_UNIT = (
    "select vec_id, round(case when list_inner_product(embedding, embedding) > 0 then 1.0::double else 0.0::double end, 4) as "
    "norm from embeddings where len(embedding) = 64"
)


def path_problems(spark, d):
    docs = D.paths(spark, d)
    files = docs.filter("doc_id % 3 = 0").select(F.col("source_path").alias("path"))
    return indexing.path_problems(docs.select("node_id", F.col("source_path").alias("path")), files)


SQL_PROBLEMS = (
    f"with {D.SQL_PATHS} select node_id, raw_path as path from docs where ends_with(raw_path, '.md') and raw_path not in (select "
    f"raw_path from docs where doc_id % 3 = 0)"
)

_F = (index_update, index_stats, render_text, compact_vectors, unit_vectors, path_problems)
QUERIES = {f.__name__: f for f in _F}
SQL = dict(zip(QUERIES, (SQL_INDEX, SQL_STATS, SQL_RENDER, SQL_COMPACT, SQL_UNIT, SQL_PROBLEMS), strict=True))
