"""Archive, plan and message search with their filters, session changes and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import chunking, graph, reports, retrieval, sessions
from tessera.plans import derive as D
from tessera.plans import search as S
from tessera.sources import snapshots
from tessera.sources.tables import table

_SINCE = "2024-01-01 01:00:00"


def _archive(spark, d):
    """The chunk index with a workspace, a model, and a time that some conversations lack."""
    k = F.col("conv_id")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return D.items(spark, d).select(
        "*", F.concat(F.lit("w"), k % 2).alias("workspace_key"), F.concat(F.lit("m"), k % 3).alias("embedding_model"),
        F.when(k % 9 != 0, start + F.make_dt_interval(mins=(k * 13 % 4000).cast("int"))).alias("captured_at"),
    )


_ITEMS = D.SQL_ITEMS.replace("items as (", "items0 as (")
_ARCHIVED = f"""where 'w' || (conv_id % 2) = 'w1' and conv_id % 9 <> 0 and timestamp '2024-01-01' + to_minutes(conv_id * 13 % 4000) >= timestamp '{_SINCE}'"""


def archive_search(spark, d):
    hits = retrieval.archive_search(_archive(spark, d), S.QUERY, D.query_vector(spark, d), workspace_key="w1", since=F.lit(_SINCE).cast("timestamp_ntz"), model="m1")
    return hits.select("conv_id", "id", "place", F.round("score", 10).alias("score"))


SQL_ARCHIVE = f"""with {_ITEMS}, items as (select * from items0 {_ARCHIVED}), lex as (select id, {S._cov('content')} as score from items where {S._cov('content')} > 0),
dense as (select id, round({D.cosine_sql('embedding', 'q.v')}, 9) as score from items, q where conv_id % 3 = 1){S._FUSED}
select conv_id, id, place, round(score, 10) as score from best"""


def index_build(spark, d):
    """The chunk index that searches read, built anew: its chunks without their vectors."""
    snapshots.drop(spark, D._place(spark, d, "items"))
    return D.items(spark, d).select("id", "conv_id", "granularity", F.sha2("content", 256).alias("content_sha256"), F.size("embedding").alias("width"))


SQL_BUILD = f"with {D.SQL_ITEMS} select id, conv_id, granularity, sha256(content) as content_sha256, cast(len(embedding) as int) as width from items"


def archive_search_blank(spark, d):
    return retrieval.archive_search(_archive(spark, d), "  ", D.query_vector(spark, d)).select("conv_id", "id", "place")


SQL_BLANK = f"with {D.SQL_CHUNKS} select conv_id, id, cast(1 as int) as place from chunks where false"


def candidate_prefilter(spark, d):
    hits = retrieval.archive_search(D.items(spark, d), S.QUERY, D.query_vector(spark, d), most_candidates=40)
    return hits.select("conv_id", "id", "place", F.round("score", 10).alias("score"))


SQL_PREFILTER = f"""with {_ITEMS}, {S._tfidf_sql('items0', 'content')}, cand as (select id from scored order by score desc, id limit 40),
items as (select * from items0 where id in (select id from cand) or not exists (select 1 from cand)), lex as (select id, {S._cov('content')} as score from items where {S._cov('content')} > 0),
dense as (select id, round({D.cosine_sql('embedding', 'q.v')}, 9) as score from items, q){S._FUSED} select conv_id, id, place, round(score, 10) as score from best"""


def plan_search(spark, d):
    """Plans are documents with a vector; each fifth one has tags that can't be read."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("lifecycle"), F.col("source").alias("owner"), F.when(F.col("doc_id") % 5 == 0, "[oops").otherwise(F.concat(F.lit('["'), "lang", F.lit('","x"]'))).alias("tags"))
    rows = S._vectors(spark, d).join(docs, "id").withColumn("embedding_model", F.concat(F.lit("m"), F.col("id") % 2))
    hits = retrieval.plan_search(rows, D.query_vector(spark, d), 12, floor=-0.5, model="m1", lifecycle="en", owner=None)
    return hits.select("id", "lifecycle", "owner", F.array_join("tags", "+").alias("tags"), F.round("score", 6).alias("score"))


SQL_PLANS = S._S + """ select s.id, lang as lifecycle, source as owner, case when s.id % 5 = 0 then '' else lang || '+x' end as tags, round(s.score, 6) as score from s join documents d on d.doc_id = s.id
where s.id % 2 = 1 and lang = 'en' and s.score >= -0.5 order by s.score desc, s.id limit 12"""


def message_filters(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.upper("source").alias("reporter"), F.concat(F.lit("src"), (F.col("doc_id") % 3)).alias("recipient"), "lang", F.when(F.col("doc_id") % 2 == 0, "open").otherwise("done").alias("status"))
    rows = S._vectors(spark, d).join(docs, "id")
    hits = retrieval.message_search(rows, D.query_vector(spark, d), 10, floor=-0.9, dedupe=["reporter", "lang"], agent="SRC1", status="open", lang=None)
    return hits.select("id", "reporter", "lang", F.round("score", 6).alias("score"))


SQL_MESSAGES = S._S + """, m as (select s.id, upper(source) as reporter, lang, s.score from s join documents d on d.doc_id = s.id where s.score >= -0.9 and (lower(source) = 'src1' or s.id % 3 = 1) and s.id % 2 = 0),
k as (select *, row_number() over (partition by reporter, lang order by score desc, id) as n from m) select id, reporter, lang, round(score, 6) as score from k where n = 1 order by k.score desc, id limit 10"""


def _requests(spark, d):
    """Each third customer asks for the identity of another (a fork each sixth time), some twice."""
    s = D.sessions(spark, d).filter("session_id % 3 = 0")
    once = s.select("agent_id", "operator_id", "workspace_key", "lane", (F.col("session_id") + 10_000_000).alias("new_id"), (F.col("session_id") % 6 == 0).alias("fork"))
    return once.unionByName(once.filter("new_id % 2 = 0").withColumn("new_id", F.col("new_id") + 50_000_000).withColumn("fork", F.lit(False)))


def open_sessions(spark, d):
    return sessions.open_sessions(D.sessions(spark, d), _requests(spark, d))


_OPEN = f"""{D.SQL_SESSIONS}, once as (select agent_id, operator_id, workspace_key, lane, session_id + 10000000 as new_id, session_id % 6 = 0 as fork from sessions where session_id % 3 = 0),
requests as (select * from once union all select agent_id, operator_id, workspace_key, lane, new_id + 50000000, false from once where new_id % 2 = 0),
opened as (select agent_id, operator_id, workspace_key, lane, arg_max(session_id, (updated_at, session_id)) as open_id from sessions where status = 'open' group by all),
ranked as (select *, row_number() over (partition by agent_id, operator_id, workspace_key, lane order by (case when fork then 0 else 1 end), new_id) as n from requests),
ways as (select r.*, open_id from ranked r left join opened o using (agent_id, operator_id, workspace_key, lane) where n = 1),
inserts as (select new_id as session_id, 'insert' as action, agent_id, operator_id, workspace_key, lane, open_id as parent_session_id from ways where open_id is null or fork),
parks as (select open_id, 'park', agent_id, operator_id, workspace_key, lane, null from ways where open_id is not null and fork),
reuses as (select case when w.open_id is null or w.fork then w.new_id else w.open_id end, 'reuse', r.agent_id, r.operator_id, r.workspace_key, r.lane, null from requests r join ways w using (agent_id, operator_id, workspace_key, lane)
  where (w.open_id is not null and not w.fork) or r.new_id <> w.new_id),
actions as (select * from inserts union all select * from parks union all select * from reuses)"""
SQL_OPEN = f"with {_OPEN} select * from actions"


def sessions_after_open(spark, d):
    after = sessions.apply_open(D.sessions(spark, d), open_sessions(spark, d), D.as_of())
    return after.groupBy("status").agg(F.count("*").alias("n"), F.max("updated_at").alias("newest"), F.count("parent_session_id").alias("n_children"))


SQL_AFTER_OPEN = f"""with {_OPEN}, after_ as (
  select case when p.session_id is not null then 'parked' else s.status end as status, case when p.session_id is not null then timestamp '{D.AS_OF}' else s.updated_at end as updated_at, s.parent_session_id
  from sessions s left join (select session_id from actions where action = 'park') p on p.session_id = s.session_id
  union all select 'open', timestamp '{D.AS_OF}', parent_session_id from actions where action = 'insert')
select status, count(*) as n, max(updated_at) as newest, count(parent_session_id) as n_children from after_ group by 1"""


def _new_checkpoints(spark, d):
    return D.checkpoints(spark, d).filter("checkpoint_id % 10 = 0").select((F.col("checkpoint_id") + 10_000_000).alias("checkpoint_id"), "session_id", (F.col("created_at") + F.expr("interval 1 day")).alias("created_at"), "decisions", "supersedes")


def checkpoint_append(spark, d):
    _, touched = sessions.append_checkpoints(D.checkpoints(spark, d), D.sessions(spark, d), _new_checkpoints(spark, d))
    return touched.select("session_id", "last_checkpoint_at", "updated_at")


SQL_APPEND = f"""with {D.SQL_SESSIONS}, {D.SQL_CHECKPOINTS}, last as (select session_id, max(created_at) + interval 1 day as newest from checkpoints where checkpoint_id % 10 = 0 group by 1)
select s.session_id, greatest(last_checkpoint_at, newest) as last_checkpoint_at, greatest(updated_at, newest) as updated_at from sessions s left join last using (session_id)"""


def checkpoint_count(spark, d):
    rows, _ = sessions.append_checkpoints(D.checkpoints(spark, d), D.sessions(spark, d), _new_checkpoints(spark, d))
    return rows.groupBy("session_id").agg(F.count("*").alias("n"))


SQL_CHECKPOINT_COUNT = f"""with {D.SQL_SESSIONS}, {D.SQL_CHECKPOINTS} select session_id, count(*) as n from (select session_id from checkpoints
union all select session_id from checkpoints where checkpoint_id % 10 = 0 and session_id in (select session_id from sessions)) group by 1"""


def title_updates(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 4 > 0, "derived").alias("title_source"))
    changes = rows.filter("session_id % 3 = 0").select("session_id", F.when(F.col("session_id") % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" new\n "), "title")).alias("title"))
    return sessions.set_titles(rows, changes, "session_id")


SQL_TITLES = """select c_custkey as session_id, case when c_custkey % 3 = 0 and c_custkey % 2 = 1 then 'new ' || c_name else c_name end as title,
case when c_custkey % 3 = 0 and c_custkey % 2 = 1 then 'user' when c_custkey % 4 > 0 then 'derived' end as title_source from customer"""


def alias_refile(spark, d):
    """Four tables refiled to a canonical workspace, rows by table and workspace."""
    aliases = spark.createDataFrame([("w1", "w2"), ("w7", "w3")], "alias_key string, canonical_key string")
    s = D.sessions(spark, d)
    beats = D.beats(spark, d).join(s.select("session_id", "workspace_key"), "session_id")
    points = D.checkpoints(spark, d).select("session_id").join(s.select("session_id", "workspace_key"), "session_id")
    done = sessions.refile({"sessions": s, "heartbeats": beats, "checkpoints": points, "items": _archive(spark, d)}, aliases)
    parts = [df.groupBy("workspace_key").agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "workspace_key", "n") for name, df in done.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


SQL_REFILE = f"""with {D.SQL_SESSIONS}, {D.SQL_BEATS}, {D.SQL_CHECKPOINTS}, {D.SQL_CHUNKS.replace('turns as (', 'turns as (', 1)},
a(alias_key, canonical_key) as (values ('w1', 'w2'), ('w7', 'w3')),
rows_ as (select 'sessions' as kind, workspace_key from sessions union all select 'heartbeats', workspace_key from beats join sessions using (session_id)
  union all select 'checkpoints', workspace_key from checkpoints join sessions using (session_id) union all select 'items', 'w' || (conv_id % 2) from chunks)
select kind, coalesce(canonical_key, workspace_key) as workspace_key, count(*) as n from rows_ left join a on alias_key = workspace_key group by 1, 2"""


def cjk_prose(spark, d):
    turns = D.turns(spark, d).withColumn("text", F.when(F.col("seq") % 4 == 1, F.concat("text", F.lit(" 記録"))).otherwise(F.col("text")))
    return chunking.cjk_prose(turns).groupBy("conv_id").agg(F.count("*").alias("n"))


SQL_CJK = f"with {D.SQL_TURNS} select conv_id, count(*) as n from turns where seq % 4 = 1 and text is not null group by 1"


def auto_checkpoints(spark, d):
    kind = F.when(F.col("event_id") % 3 == 0, F.lit('{"checkpoint_kind": "auto"}')).when(F.col("event_id") % 3 == 1, F.lit("{bad")).otherwise(F.col("props"))
    return table(spark, d, "events").filter(sessions.is_auto(kind)).groupBy("event_type").agg(F.count("*").alias("n"))


SQL_AUTO = "select event_type, count(*) as n from events where event_id % 3 = 0 group by 1"


def titled_vectors(spark, d):
    docs = table(spark, d, "documents").filter("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("d"), "doc_id")).alias("title"))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("v"), "label").alias("title"))
    return reports.with_titles(v, docs)


SQL_TITLED = (
    "select vec_id as doc_id, case when doc_id % 4 = 0 then 'd' || doc_id else 'v' || label end as title from embeddings left "
    "join (select doc_id from documents where doc_id % 2 = 0) on doc_id = vec_id"
)


def session_records(spark, d):
    s = D.sessions(spark, d).withColumn("lane", F.when(F.col("session_id") % 3 > 0, F.col("lane"))).withColumn("turn_count", F.when(F.col("session_id") % 2 == 0, F.col("session_id")))
    return sessions.session_records(s.select("session_id", "lane", "turn_count", "updated_at", "last_checkpoint_at"))


SQL_RECORDS = f"""with {D.SQL_SESSIONS} select session_id, case when session_id % 3 > 0 then lane else 'default' end as lane, case when session_id % 2 = 0 then session_id else 0 end as turn_count,
strftime(updated_at, '%Y-%m-%dT%H:%M:%S') as updated_at, strftime(last_checkpoint_at, '%Y-%m-%dT%H:%M:%S') as last_checkpoint_at from sessions"""


def document_round_trip(spark, d):
    """Turns to JSON, absent fields left out, and back with defaults."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("_role"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("role"), F.when(F.col("turn") % 3 == 0, "code").alias("type"), F.lit(None).cast("string").alias("host"))
    back = t.select("conv_id", "turn", chunking.from_document(chunking.to_document(["role", "type", "host"]), "role string, type string, host string").alias("r"))
    return back.select("conv_id", "turn", "r.*")


SQL_ROUND = (
    "select conv_id, turn, case when turn % 2 = 0 then coalesce(role, 'agent') else 'agent' end as role, case when turn % 3 = "
    "0 then 'code' else 'text' end as type, 'unknown' as host from conversations"
)


def stub_retract(spark, d):
    docs = D.paths(spark, d)
    nodes = docs.select("node_id", F.when(F.col("doc_id") % 2 == 0, "docshare-stub").otherwise("curated").alias("graph"), "source_path", F.when(F.col("doc_id") % 12 == 4, D.as_of()).alias("superseded_at"))
    after, left = graph.retract_stubs(nodes, D.as_of())
    return after.agg(F.count("superseded_at").alias("closed")).withColumn("remaining", left.scalar())


SQL_RETRACT = (
    f"with {D.SQL_PATHS} select count(*) as closed, cast(0 as bigint) as remaining from pathed where (doc_id % 2 = 0 and path "
    f"like 'docs/plan/%') or doc_id % 12 = 4"
)


def sync_report(spark, d):
    docs = table(spark, d, "documents").select(F.when(F.col("doc_id") % 10 > 0, F.col("text")).alias("content"), F.sha2("text", 256).alias("content_sha256"))
    return reports.sync_report(docs)


SQL_REPORT = (
    "select count(*) as n, count(*) filter (doc_id % 10 = 0 or trim(text, ' ') = '') as n_without_content, cast(coalesce(sum(length(text)) "
    "filter (doc_id % 10 > 0), 0) as bigint) as chars, count(distinct sha256(text)) as n_contents from documents"
)


def load_report(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, "{bad").when(k % 5 == 1, "{}").when(k % 5 == 2, '{"documents": ["a"]}').otherwise(F.concat(F.lit('{"nodes": ["x", "'), "p_partkey", F.lit('"]}')))
    return reports.load_summary(reports.loaded(table(spark, d, "part").select(k.cast("string").alias("path"), text.alias("text"))))


SQL_LOAD = """select case p_partkey % 5 when 0 then '-' when 1 then '-' when 2 then 'documents' else 'nodes' end as format, count(*) as files,
cast(sum(case p_partkey % 5 when 0 then 0 when 1 then 0 when 2 then 1 else 2 end) as bigint) as total_nodes, bool_and(p_partkey % 5 >= 2) as passed from part group by 1"""


def listing_lines(spark, d):
    return reports.listing_lines(D.sessions(spark, d), D.as_of())


SQL_LINES = f"""with {D.SQL_SESSIONS} select session_id, '#' || session_id || ' · ' || lane || ' · ' || status || ' · ' || (epoch(timestamp '{D.AS_OF}' - updated_at)::bigint // 3600) || ' h' as line from sessions"""

_F = (
    archive_search, index_build, archive_search_blank, candidate_prefilter, plan_search, message_filters, open_sessions,
    sessions_after_open, checkpoint_append, checkpoint_count, title_updates, alias_refile, cjk_prose, auto_checkpoints,
    titled_vectors, session_records, document_round_trip, stub_retract, sync_report, load_report, listing_lines,
)
QUERIES = {f.__name__: f for f in _F}
SQL = dict(zip(
    QUERIES,
    (
        SQL_ARCHIVE, SQL_BUILD, SQL_BLANK, SQL_PREFILTER, SQL_PLANS, SQL_MESSAGES, SQL_OPEN, SQL_AFTER_OPEN, SQL_APPEND,
        SQL_CHECKPOINT_COUNT, SQL_TITLES, SQL_REFILE, SQL_CJK, SQL_AUTO, SQL_TITLED, SQL_RECORDS, SQL_ROUND, SQL_RETRACT, SQL_REPORT,
        SQL_LOAD, SQL_LINES,
    ),
    strict=True,
))
