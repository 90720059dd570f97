"""Queries over stored forms (bodies, packed vectors, cached embeddings) and over trees in reading order, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import codecs
from tessera.operators import batching, json_schema, memo, sessions
from tessera.operators.staging import base_dir
from tessera.plans import derive as D
from tessera.sources.tables import table

_START = "2024-01-01 00:00:00"


def _stored(spark, d):
    """Every conversation as a deflated document; each seventh body is cut, each eleventh missing."""
    text = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("tool_input"))
    tool = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("shell").alias("tool_name"), F.col("role").alias("tool_input"))
    turns = D.turns(spark, d).withColumn("blocks", F.when(F.col("seq") % 2 == 0, F.array(text, tool)).otherwise(F.array(text)))
    k = F.col("conv_id")
    docs = codecs.document(turns.withColumn("source_ref", k.cast("string")).withColumn("redaction_count", F.lit(1)), "conv_id")
    body = codecs.body_of(F.col("doc"))
    at = F.lit(_START).cast("timestamp_ntz") + F.make_dt_interval(mins=(k % 50).cast("int"))
    rows = docs.select(k.alias("transcript_id"), F.concat(F.lit("w"), k % 3).alias("workspace_key"), F.col("doc.source_ref").alias("source_ref"), at.alias("captured_at"), body.alias("whole"))
    cut = F.when(F.col("transcript_id") % 11 == 4, F.lit(None)).when(F.col("transcript_id") % 7 == 3, F.expr("substring(whole, 1, octet_length(whole) - 5)")).otherwise(F.col("whole"))
    return rows.select("transcript_id", "workspace_key", "source_ref", "captured_at", cut.alias("body"))


def transcript_bodies(spark, d):
    """All bodies inflated and parsed into turns and blocks; those that can't be read are a row without turns."""
    docs = codecs.with_documents(_stored(spark, d).select("transcript_id", "body"))
    turns = docs.select("transcript_id", F.col("doc").isNotNull().alias("readable"), "doc.source_host", "doc.redaction_count", F.explode_outer("doc.turns").alias("t"))
    blocks = turns.select("transcript_id", "readable", "source_host", "redaction_count", "t.seq", "t.role", F.posexplode_outer("t.blocks").alias("pos", "b"))
    return blocks.select("transcript_id", "readable", "source_host", "redaction_count", "seq", "role", "pos", "b.type", F.sha2("b.text", 256).alias("text_sha256"), "b.tool_name", "b.tool_input")


_BROKEN = "(conv_id % 11 = 4 or conv_id % 7 = 3)"
SQL_BODIES = f"""
with {D.SQL_TURNS}, sound as (select *, count(*) over (partition by conv_id) as n_turns from turns where not {_BROKEN})
select conv_id as transcript_id, true as readable, 'unknown' as source_host, cast(n_turns as int) as redaction_count, seq, role, cast(0 as int) as pos, 'text' as type, sha256(text) as text_sha256,
  cast(null as varchar) as tool_name, cast(null as varchar) as tool_input from sound
union all select conv_id, true, 'unknown', cast(n_turns as int), seq, role, 1, 'tool_use', null, 'shell', role from sound where seq % 2 = 0
union all select distinct conv_id, false, null, cast(null as int), cast(null as int), null, cast(null as int), null, null, null, null from turns where {_BROKEN}
"""


def newest_transcripts(spark, d):
    """The conversation of each workspace that was captured last."""
    found = codecs.newest_transcripts(_stored(spark, d))
    return found.select("workspace_key", "transcript_id", F.col("doc").isNotNull().alias("readable"), F.size("doc.turns").alias("n_turns"))


SQL_NEWEST = f"""
with {D.SQL_TURNS}, c as (select conv_id, count(*) as n from turns group by conv_id),
r as (select *, row_number() over (partition by conv_id % 3 order by conv_id % 50 desc, conv_id desc) as k from c)
select 'w' || (conv_id % 3) as workspace_key, conv_id as transcript_id, not {_BROKEN} as readable, cast(case when not {_BROKEN} then n end as int) as n_turns from r where k = 1
"""


def vector_codec(spark, d):
    """Vectors packed and unpacked; each fifth is cut, each seventh is of another width."""
    k = F.col("vec_id")
    packed = table(spark, d, "embeddings").select("vec_id", "embedding", codecs.pack_vector(F.col("embedding")).alias("blob"))
    stored = packed.select("vec_id", "embedding", F.when(k % 5 == 2, F.expr("substring(blob, 1, 63)")).when(k % 7 == 3, F.expr("substring(blob, 1, 64)")).otherwise(F.col("blob")).alias("blob"))
    read = stored.select("vec_id", "embedding", F.octet_length("blob").alias("bytes"), codecs.unpack_vector(F.col("blob"), 64).alias("back"))
    return read.select("vec_id", "bytes", F.size("back").alias("width"), (F.col("back") == F.col("embedding")).alias("same"))


SQL_VECTORS = """
select vec_id, cast(case when vec_id % 5 = 2 then 63 when vec_id % 7 = 3 then 64 else 256 end as int) as bytes,
  cast(case when vec_id % 5 <> 2 and vec_id % 7 <> 3 then 64 end as int) as width, case when vec_id % 5 <> 2 and vec_id % 7 <> 3 then true end as same from embeddings
"""


def _memoised(spark, d):
    """Turns of the even conversations are embedded, then all turns; blank texts have no vector."""
    base = f"{base_dir(spark)}/memo-{uuid.uuid4().hex}"
    texts = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit(" "), F.regexp_replace(F.coalesce("text", F.lit("")), " ", "  ")).alias("text"))
    fn = batching.hashing_embedder(8)
    _, first = memo.embed(texts.filter("conv_id % 2 = 0"), base, "m1", fn)
    rows, second = memo.embed(texts, base, "m1", fn)
    return rows, [first, second]


def embed_memo(spark, d):
    """Each turn's key, and whether its vector was there before."""
    rows, _ = _memoised(spark, d)
    return rows.select("conv_id", "turn", "memo_key", F.coalesce("hit", F.lit(False)).alias("hit"), F.size("embedding").alias("width"))


_FLAT = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' ')"
SQL_MEMO = f"""
with k as (select conv_id, turn, {_FLAT} as flat, sha256('m1' || chr(10) || '0' || chr(10) || {_FLAT}) as memo_key from conversations)
select conv_id, turn, memo_key, flat <> '' and memo_key in (select memo_key from k where conv_id % 2 = 0) as hit, cast(case when flat <> '' then 8 end as int) as width from k
"""


def embed_memo_stats(spark, d):
    _, steps = _memoised(spark, d)
    return spark.createDataFrame([(i, s["asked"], s["found"], s["embedded"]) for i, s in enumerate(steps)], "step int, asked long, found long, embedded long")


SQL_MEMO_STATS = f"""
with k as (select distinct {_FLAT} as flat, conv_id % 2 = 0 as even from conversations), e as (select distinct flat from k where even), a as (select distinct flat from k)
select 0 as step, count(*) as asked, 0 as found, count(*) filter (flat <> '') as embedded from e
union all select 1, count(*), count(*) filter (flat <> '' and flat in (select flat from e)), count(*) filter (flat <> '' and flat not in (select flat from e)) from a
"""


def tree_preorder(spark, d):
    """Sessions of each workspace in reading order."""
    return sessions.ordered_tree(D.sessions(spark, d), "updated_at").select("session_id", "root", "depth", "position", "size", "path")


SQL_PREORDER = f"""
with recursive {D.SQL_SESSIONS}, own as (
  select s.session_id, p.session_id as parent, s.updated_at from sessions s left join sessions p on p.session_id = s.parent_session_id and p.workspace_key = s.workspace_key
), sib as (select *, row_number() over (partition by parent order by updated_at, session_id) as k from own),
t(session_id, root, depth, ks, path) as (
  select session_id, session_id, cast(0 as bigint), [cast(0 as bigint)], cast(session_id as varchar) from sib where parent is null
  union all select s.session_id, t.root, t.depth + 1, list_append(t.ks, s.k), t.path || '/' || s.session_id from t join sib s on s.parent = t.session_id
), sizes as (select a.session_id, count(*) as size from t a join t b on b.root = a.root and starts_with(b.path || '/', a.path || '/') group by a.session_id)
select t.session_id, root, depth, row_number() over (partition by root order by ks) - 1 as position, size, path from t join sizes using (session_id)
"""

#: What an event should be like, as a JSON Schema.
EVENT_SCHEMA = {
    "type": "object",
    "required": ["kind", "amount", "detail"],
    "properties": {
        "kind": {"type": "string", "enum": ["click", "purchase", "view", "signup"], "minLength": 5},
        "amount": {"oneOf": [{"type": "integer"}, {"type": "number"}]},
        "at": {"type": "string", "pattern": "^2024-0[1-6]-"},
        "detail": {"$ref": "#/definitions/detail"},
        "users": {"type": "array", "items": {"type": ["integer", "null"]}},
    },
    "definitions": {"detail": {"type": "object", "properties": {"k": {"type": "integer", "enum": list(range(50))}}, "additionalProperties": {"type": "string"}}},
}


def event_findings(spark, d):
    """Events as JSON documents against a schema that not all of them keep."""
    e = table(spark, d, "events")
    detail = F.from_json("props", "struct<k:int>")["k"]
    doc = F.to_json(
        F.struct(
            F.col("event_type").alias("kind"), F.col("value").alias("amount"), F.date_format("ts", "yyyy-MM-dd").alias("at"),
            F.struct(detail.alias("k"), F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("more")).alias("detail"), F.array("user_id", "value").alias("users"),
        )
    )
    return json_schema.findings(e.select("event_id", doc.alias("value")), EVENT_SCHEMA, key="event_id")


_ENUM = ", ".join(str(i) for i in range(50))
SQL_EVENTS = f"""
with e as (select *, cast(props ->> '$.k' as int) as k, value = floor(value) as whole from events)
select event_id, 'kind' as at, 'enum' as rule, '["click", "purchase", "view", "signup"]' as detail from e where event_type not in ('click', 'purchase', 'view', 'signup')
union all select event_id, 'kind', 'minLength', '5' from e where length(event_type) < 5
union all select event_id, 'amount', 'oneOf', '2' from e where whole
union all select event_id, 'at', 'pattern', '^2024-0[1-6]-' from e where not regexp_matches(strftime(ts, '%Y-%m-%d'), '^2024-0[1-6]-')
union all select event_id, 'detail/k', 'enum', '[{_ENUM}]' from e where k > 49
union all select event_id, 'detail/more', 'type', 'string' from e where user_id % 2 = 0
union all select event_id, 'users/1', 'type', 'integer,null' from e where not whole
"""

_F = (event_findings, transcript_bodies, newest_transcripts, vector_codec, embed_memo, embed_memo_stats, tree_preorder)
QUERIES = {f.__name__: f for f in _F}
SQL = dict(zip(QUERIES, (SQL_EVENTS, SQL_BODIES, SQL_NEWEST, SQL_VECTORS, SQL_MEMO, SQL_MEMO_STATS, SQL_PREORDER), strict=True))
