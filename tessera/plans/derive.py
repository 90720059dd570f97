"""The engine's tables (turns, chunks, sessions, checkpoints, nodes, ...) derived from the given ones, in DataFrames and in SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunking, postings, synced
from tessera.operators.staging import base_dir
from tessera.sources.tables import table

AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def turns(spark: SparkSession, d: str) -> DataFrame:
    return chunking.turns_of(table(spark, d, "conversations"))


SQL_TURNS = """turns as (
  select * from (select conv_id, cast(turn + 1 as int) as seq,
    case role when 'user' then 'human' when 'human' then 'human' when 'assistant' then 'agent' when 'agent' then 'agent' when 'system' then 'system' end as role,
    text from conversations) where role is not null
), prose as (
  select *, row_number() over (partition by conv_id order by seq) - 1 as idx, count(*) over (partition by conv_id) as n,
    '[' || seq || '] ' || upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || trim(text, ' ') as line
  from turns where trim(text, ' ') <> ''
)"""

SQL_CHUNKS = (
    SQL_TURNS
    + """, starts as (
  select conv_id, idx as s, least(5, n) as size from prose where idx <= n - least(5, n) and (idx % 3 = 0 or idx = n - least(5, n))
), bodies as (
  select p.conv_id, 'window' as granularity, min(p.seq) as seq_start, max(p.seq) as seq_end, string_agg(p.line, chr(10) || chr(10) order by p.seq) as body
  from starts s join prose p on p.conv_id = s.conv_id and p.idx between s.s and s.s + s.size - 1 group by p.conv_id, s.s
  union all
  select conv_id, 'session', min(seq), max(seq), string_agg(line, chr(10) || chr(10) order by seq) from prose group by conv_id
), chunks as (
  select conv_id || ':' || granularity || ':' || seq_start || ':' || seq_end as id, conv_id, granularity, seq_start, seq_end,
    case when length(body) > 6000 then substr(body, 1, 6000) || '…' else body end as content
  from bodies where length(body) >= 40
)"""
)

SQL_ITEMS = SQL_CHUNKS + """, items as (
  select c.*, e.embedding from chunks c join embeddings e on e.vec_id = (c.conv_id * 31 + c.seq_start * 7 + c.seq_end) % (select count(*) from embeddings)
), q as (select cast(embedding as double[]) as v from embeddings where vec_id = 0)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(turns(spark, d))


def _place(spark: SparkSession, d: str, name: str) -> str:
    """The folder of a derived table of the tables at `d`."""
    return f"{base_dir(spark)}/{name}-{hashlib.sha256(d.encode()).hexdigest()[:16]}"


def _files(d: str, *names: str) -> list[str]:
    return [f"{d}/{n}.parquet" for n in names]


def conversation_digests(turns_: DataFrame) -> DataFrame:
    """(conv_id, digest): equal for equal sets of turns, whatever their order; summed before the shuffle."""
    each = F.xxhash64("seq", "role", "text").cast("decimal(38,0)")
    return turns_.groupBy("conv_id").agg(F.concat_ws(":", F.count("*"), F.sum(each).cast("string")).alias("digest"))


def synced_items(spark: SparkSession, d: str, base: str | None = None, buckets: int = 8) -> synced.Synced:
    """The chunk index: chunks with a vector each, kept in step with the conversations and the vectors at `d`. Only conversations
    that are new or changed are cut in chunks again; other vectors change them all."""
    from tessera.sources.snapshots import signature

    def units() -> DataFrame:
        model = signature(spark, _files(d, "embeddings"))
        return conversation_digests(turns(spark, d)).select("conv_id", F.concat_ws(":", "digest", F.lit(model)).alias("digest"))

    def derive(keys: DataFrame | None) -> DataFrame:
        return build_index(spark, d, keys)

    return synced.sync(spark, base or _place(spark, d, "items"), lambda: signature(spark, _files(d, "conversations", "embeddings")), units, derive, "conv_id", buckets)


def items(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the chunk index, brought up to date first."""
    return synced_items(spark, d).rows


def build_index(spark: SparkSession, d: str, conversations: DataFrame | None = None) -> DataFrame:
    """Chunks of all conversations (or of some), each with a vector."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    said = turns(spark, d)
    said = said if conversations is None else said.join(conversations, "conv_id", "left_semi")
    rows = chunking.chunks(said).withColumn("vec_id", F.pmod(F.col("conv_id") * 31 + F.col("seq_start") * 7 + F.col("seq_end"), F.lit(vectors.count())))
    return rows.join(vectors, "vec_id").drop("vec_id")


def item_postings(spark: SparkSession, d: str) -> postings.Index:
    """The inverted index of the chunks, brought up to date first."""
    from tessera.sources.snapshots import signature

    held = synced_items(spark, d)
    now = f"{held.version}:{signature(spark, _files(d, 'conversations', 'embeddings'))}"
    return postings.sync(spark, _place(spark, d, "item-postings"), lambda: now, lambda: held.rows.select("id", "content"), buckets=8)


def document_postings(spark: SparkSession, d: str, base: str | None = None) -> postings.Index:
    """The inverted index of the documents' whole texts, brought up to date first."""
    from tessera.sources.snapshots import signature

    docs = lambda: table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return postings.sync(spark, base or _place(spark, d, "document-postings"), lambda: signature(spark, _files(d, "documents")), docs, buckets=16)


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The one vector that stands for the query."""
    return table(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()["embedding"]


def cosine_sql(a: str, b: str, eps: str = "") -> str:
    return f"(list_inner_product(cast({a} as double[]), {b}) / ((sqrt(list_inner_product(cast({a} as double[]), cast({a} as double[]))){eps}) * (sqrt(list_inner_product({b}, {b})){eps})))"


def sessions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    start = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return c.select(
        F.col("c_custkey").alias("session_id"),
        F.when(F.col("c_custkey") >= 2, F.floor(F.col("c_custkey") / 2).cast("long")).alias("parent_session_id"),
        F.concat(F.lit("a"), F.pmod(F.floor(F.col("c_custkey") / 4).cast("long"), F.lit(3))).alias("agent_id"),
        F.col("c_mktsegment").alias("operator_id"),
        F.concat(F.lit("w"), F.col("c_nationkey")).alias("workspace_key"),
        F.when(F.pmod("c_custkey", F.lit(3)) == 0, "side").otherwise("default").alias("lane"),
        F.element_at(F.array(F.lit("parked"), F.lit("open"), F.lit("open"), F.lit("closed")), (F.pmod("c_custkey", F.lit(4)) + 1).cast("int")).alias("status"),
        (start + F.make_dt_interval(mins=F.pmod(F.col("c_custkey") * 37, F.lit(14000)).cast("int"))).alias("updated_at"),
        F.when(F.pmod("c_custkey", F.lit(5)) == 0, start + F.make_dt_interval(mins=F.pmod(F.col("c_custkey") * 53, F.lit(15000)).cast("int"))).alias("last_checkpoint_at"),
    )


SQL_SESSIONS = """sessions as (
  select c_custkey as session_id, case when c_custkey >= 2 then c_custkey // 2 end as parent_session_id, 'a' || (c_custkey // 4 % 3) as agent_id, c_mktsegment as operator_id,
    'w' || c_nationkey as workspace_key, case when c_custkey % 3 = 0 then 'side' else 'default' end as lane,
    ['parked', 'open', 'open', 'closed'][c_custkey % 4 + 1] as status,
    timestamp '2024-01-20 00:00:00' + to_minutes(c_custkey * 37 % 14000) as updated_at,
    case when c_custkey % 5 = 0 then timestamp '2024-01-20 00:00:00' + to_minutes(c_custkey * 53 % 15000) end as last_checkpoint_at
  from customer
)"""


def beats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("session_id"), F.concat(F.lit("h"), F.pmod("event_id", F.lit(3))).alias("host"), "ts", F.concat(F.lit("ide"), F.pmod("event_id", F.lit(4))).alias("ide"))


SQL_BEATS = "beats as (select user_id as session_id, 'h' || (event_id % 3) as host, ts, 'ide' || (event_id % 4) as ide from events)"


def checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """Clicks and errors as checkpoints; each third one has a decision, each seventh supersedes the one 70 before it."""
    e = table(spark, d, "events").filter(F.col("event_type").isin("click", "error"))
    some = F.pmod("event_id", F.lit(3)) == 0
    over = (F.pmod("event_id", F.lit(7)) == 0) & (F.col("event_id") >= 70)
    none = F.array().cast("array<string>")
    return e.select(
        F.col("event_id").alias("checkpoint_id"), F.col("user_id").alias("session_id"), F.col("ts").alias("created_at"),
        F.when(some, F.array(F.concat(F.lit("d"), F.get_json_object("props", "$.k")))).otherwise(none).alias("decisions"),
        F.when(over, F.array(F.col("event_id") - 70)).otherwise(F.array().cast("array<bigint>")).alias("supersedes"),
    )


SQL_CHECKPOINTS = """checkpoints as (
  select event_id as checkpoint_id, user_id as session_id, ts as created_at,
    case when event_id % 3 = 0 then 'd' || (props ->> '$.k') end as decision,
    case when event_id % 7 = 0 and event_id >= 70 then event_id - 70 end as supersedes
  from events where event_type in ('click', 'error')
)"""


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Parts as nodes: a parent for all but each hundredth; some parents don't exist, some ids repeat."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    own = p.select(
        k.cast("string").alias("id"),
        F.when(k == 0, "root").when(F.pmod(k, F.lit(10)) == 0, "category").otherwise("document").alias("type"),
        F.when(F.pmod(k, F.lit(97)) == 5, F.lit("gone")).when(F.pmod(k, F.lit(100)) != 50, F.floor(k / 10).cast("long").cast("string")).alias("parent"),
        F.when(F.pmod(k, F.lit(10)) == 0, F.array((k * 10 + 1).cast("string"))).otherwise(F.array().cast("array<string>")).alias("children"),
    )
    return own.unionByName(own.filter(F.pmod(F.col("id").cast("long"), F.lit(250)) == 7))


SQL_NODES = """own as (
  select cast(p_partkey as varchar) as id, case when p_partkey = 0 then 'root' when p_partkey % 10 = 0 then 'category' else 'document' end as type,
    case when p_partkey % 97 = 5 then 'gone' when p_partkey % 100 <> 50 then cast(p_partkey // 10 as varchar) end as parent,
    case when p_partkey % 10 = 0 then cast(p_partkey * 10 + 1 as varchar) end as child
  from part
), nodes as (select * from own union all select * from own where cast(id as bigint) % 250 = 7)"""


def paths(spark: SparkSession, d: str) -> DataFrame:
    """Documents at paths of every kind of rule."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    kinds = F.array(
        F.concat(F.lit("./docs/projects/active/p"), F.pmod(k, F.lit(30)), F.lit("/a"), k, F.lit(".md")),
        F.concat(F.lit("docs\\architecture\\b"), k, F.lit(".md")),
        F.concat(F.lit("agents/skills/s"), k, F.lit(".json")),
        F.concat(F.lit("agents/behaviors/t"), k, F.lit(".json")),
        F.concat(F.lit("docs/plan/x"), k, F.lit(".md")),
        F.concat(F.lit("notes/n"), k, F.lit(".txt")),
    )
    return p.select(F.concat(F.lit("n"), k).alias("node_id"), F.element_at(kinds, (F.pmod(k, F.lit(6)) + 1).cast("int")).alias("source_path"), k.alias("doc_id"), F.col("p_name").alias("title"))


SQL_PATHS = r"""docs as (
  select 'n' || p_partkey as node_id, p_partkey as doc_id, p_name as title,
    ['./docs/projects/active/p' || (p_partkey % 30) || '/a' || p_partkey || '.md', 'docs\architecture\b' || p_partkey || '.md', 'agents/skills/s' || p_partkey || '.json',
     'agents/behaviors/t' || p_partkey || '.json', 'docs/plan/x' || p_partkey || '.md', 'notes/n' || p_partkey || '.txt'][p_partkey % 6 + 1] as raw_path
  from part
), pathed as (select *, nullif(regexp_replace(trim(replace(raw_path, '\', '/'), ' '), '^\./', ''), '') as path from docs)"""


def hubs(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that path rules point to: project indexes (but every third) and two of the domain roots."""
    p = table(spark, d, "part").filter("p_partkey < 30 and p_partkey % 3 <> 0")
    index = p.select(F.concat(F.lit("doc:domain:projects:active:p"), F.col("p_partkey"), F.lit(":index")).alias("node_id"))
    fixed = spark.range(1).select(F.explode(F.array(F.lit("cat-architecture"), F.lit("skills-root"))).alias("node_id"))
    return index.unionByName(fixed)


SQL_HUBS = """hubs as (
  select 'doc:domain:projects:active:p' || p_partkey || ':index' as node_id from part where p_partkey < 30 and p_partkey % 3 <> 0
  union all select unnest(['cat-architecture', 'skills-root'])
)"""
