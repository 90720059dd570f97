"""Queries that change semi-structured values, statuses and times, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import times
from tessera.operators import graph, sessions
from tessera.plans import derive as D
from tessera.plans import graphs as G
from tessera.sources import knowledge
from tessera.sources.tables import table


def _described(spark, d):
    """Nodes with attributes of all JSON types; some name their document already, some name another, some have none."""
    k = F.col("p_partkey")
    part = table(spark, d, "part").select(F.concat(F.lit("n"), k).alias("node_id"), "p_partkey", "p_size", "p_brand", "p_name")
    nested = F.to_json(F.struct(F.col("p_size").alias("size"), F.array("p_brand", "p_name").alias("tags")))
    named = F.when(k % 3 == 1, F.concat(F.lit(',"docshare_doc_id":"'), k, F.lit('"'))).when(k % 3 == 2, F.lit(',"docshare_doc_id":"other"')).otherwise("")
    text = F.when(k % 7 == 6, F.lit(None)).otherwise(F.concat(F.lit('{"a":'), nested, named, F.lit(',"n":'), "p_size", F.lit(',"z":null}')))
    return G._curated(spark, d).join(part.select("node_id", text.alias("attributes")), "node_id")


def node_backlink(spark, d):
    """The nodes' side of the links between documents and nodes."""
    return graph.backlink_nodes(_described(spark, d), G._shared_docs(spark, d)).select("node_id", "attributes")


_NESTED = """'{"size":' || p_size || ',"tags":["' || p_brand || '","' || p_name || '"]}'"""
_MEMBERS = f"""'{{"a":' || {_NESTED}"""
SQL_NODE_BACKLINK = f"""
with {D.SQL_PATHS}, {G._CURATED}, best as (select source_path, max(node_id) as node_id from curated group by 1),
doc as (select path, max(cast(doc_id as varchar)) as doc from pathed group by 1),
n as (select c.node_id, p.*, doc.doc from curated c join part p on 'n' || p_partkey = c.node_id left join best b on b.node_id = c.node_id left join doc on doc.path = b.source_path)
select node_id, case
  when p_partkey % 7 = 6 then case when doc is not null then '{{"docshare_doc_id":"' || doc || '"}}' end
  when doc is null or (p_partkey % 3 = 1 and doc = cast(p_partkey as varchar)) then {_MEMBERS} || case p_partkey % 3 when 1 then ',"docshare_doc_id":"' || p_partkey || '"' when 2 then ',"docshare_doc_id":"other"' else '' end || ',"n":' || p_size || ',"z":null}}'
  else {_MEMBERS} || ',"n":' || p_size || ',"z":null,"docshare_doc_id":"' || doc || '"}}' end as attributes from n
"""


def _linked(spark, d):
    brand = F.concat(F.lit('{"brand":"'), "p_brand", F.lit('","kg_indexed": "old","size":'), "p_size", F.lit("}"))
    meta = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 5 == 4, F.lit("not json")).otherwise(brand).alias("metadata_json"))
    return graph.linked_metadata(G._shared_docs(spark, d).join(meta, "doc_id"), G._curated(spark, d))


def doc_metadata(spark, d):
    """The documents' side, in their metadata."""
    return _linked(spark, d).select("doc_id", "metadata_json", graph.is_indexed(F.col("metadata_json")).alias("indexed"))


SQL_DOC_METADATA = f"""
with {G._BACK}
select doc_id, case when doc_id % 5 = 4 then '{{' else '{{"brand":"' || p_brand || '","size":' || p_size || ',' end || '"kg_node_id":' || coalesce('"' || kg_node_id || '"', 'null') || ',"kg_indexed":' || kg_indexed || '}}' as metadata_json, kg_indexed as indexed
from linked join part on p_partkey = doc_id
"""


def contains_text(spark, d):
    """Lists of what a node contains, as text."""
    k = F.col("p_partkey")
    items = F.concat(F.lit('["'), "p_name", F.lit('",{"name":"'), "p_brand", F.lit('","value":'), "p_size", F.lit('},{"name":"'), "p_type", F.lit('","value":"","description":"'), "p_name", F.lit('"},{"value":"'), "p_type", F.lit('"},{"name":"'), "p_type", F.lit('"},{},7,null,[1]]'))
    text = F.when(k % 5 == 4, F.lit('{"a":1}')).when(k % 7 == 6, F.lit(None)).otherwise(items)
    return table(spark, d, "part").select("p_partkey", knowledge.contains_text(text).alias("text"))


SQL_CONTAINS = """
select p_partkey, case when p_partkey % 5 = 4 or p_partkey % 7 = 6 then '' else
  p_name || chr(10) || p_brand || ': ' || p_size || chr(10) || p_type || ': ' || p_name || chr(10) || p_type || chr(10) || p_type end as text from part
"""

_ZONE = "America/New_York"


def naive_times(spark, d):
    """Events' times from epochs and from ISO texts with and without an offset, as local times."""
    e = table(spark, d, "events")
    micros = F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts").cast("timestamp_ntz")).cast("timestamp"))
    text = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    iso = F.when(F.col("event_id") % 3 == 0, F.concat(text, F.lit("Z"))).when(F.col("event_id") % 3 == 1, F.concat(text, F.lit("+02:00"))).otherwise(text)
    seconds = F.floor(micros / 1_000_000).cast("double")
    return e.select("event_id", times.of_epoch(seconds, _ZONE).alias("of_epoch"), times.of_text(iso, _ZONE).alias("of_text"))


SQL_TIMES = f"""
select event_id, timezone('{_ZONE}', timezone('UTC', date_trunc('second', ts))) as of_epoch,
  case event_id % 3 when 0 then timezone('{_ZONE}', timezone('UTC', date_trunc('second', ts))) when 1 then timezone('{_ZONE}', timezone('UTC', date_trunc('second', ts) - interval 2 hour)) else date_trunc('second', ts) end as of_text from events
"""


def status_changes(spark, d):
    """Sessions parked and closed; a status that isn't known changes nothing."""
    held = D.sessions(spark, d)
    k = F.col("session_id")
    wanted = held.filter(k % 2 == 0).select("session_id", F.when(k % 3 == 0, "closed").when(k % 3 == 1, "parked").otherwise("gone").alias("status"))
    return sessions.change_statuses(held, wanted, D.as_of()).select("session_id", "status", "updated_at")


SQL_STATUSES = f"""
with {D.SQL_SESSIONS}, w as (select *, case when session_id % 2 = 0 then case session_id % 3 when 0 then 'closed' when 1 then 'parked' end end as new from sessions)
select session_id, coalesce(new, status) as status, case when new <> status then timestamp '{D.AS_OF}' else updated_at end as updated_at from w
"""


def presentation_updates(spark, d):
    """Presentations set on conversations; captured_at stays, and what nothing is left of is null."""
    conv = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text")).withColumnRenamed("conv_id", "transcript_id")
    k = F.col("transcript_id")
    stored = conv.select("transcript_id", F.lit(D.AS_OF).cast("timestamp_ntz").alias("captured_at"), F.lit(None).cast("struct<title:map<string,string>,description:map<string,string>,turns:map<string,map<string,array<string>>>>").alias("presentation"))
    title = F.create_map(F.lit("en"), F.concat(F.lit("  "), F.substring("text", 1, 20)), F.lit("xx"), F.lit("unknown locale"))
    none = F.create_map().cast("map<string,string>")
    changes = conv.filter(k % 3 != 1).select("transcript_id", F.when(k % 3 == 0, title).otherwise(none).alias("title"), none.alias("description"), F.create_map().cast("map<string,map<string,array<string>>>").alias("turns"))
    out, _ = sessions.set_presentations(stored, changes)
    return out.select("transcript_id", "captured_at", F.element_at("presentation.title", "en").alias("title"), F.size("presentation.title").alias("n_titles"))


SQL_PRESENTED = rf"""
with c as (select conv_id, trim(regexp_replace(substr(arg_min(text, turn), 1, 20), '\s+', ' ', 'g'), ' ') as t from conversations group by conv_id)
select conv_id as transcript_id, timestamp '{D.AS_OF}' as captured_at, case when conv_id % 3 = 0 and t <> '' then t end as title, cast(case when conv_id % 3 = 0 and t <> '' then 1 end as int) as n_titles from c
"""

_F = (node_backlink, doc_metadata, contains_text, naive_times, status_changes, presentation_updates)
QUERIES = {f.__name__: f for f in _F}
SQL = dict(zip(QUERIES, (SQL_NODE_BACKLINK, SQL_DOC_METADATA, SQL_CONTAINS, SQL_TIMES, SQL_STATUSES, SQL_PRESENTED), strict=True))
