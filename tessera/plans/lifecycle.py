"""Queries over sessions, checkpoints, hosts, jobs and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph, jobs, merging, sessions
from tessera.plans import derive as D
from tessera.sources.tables import append_missing, table
from tessera.streaming import live

_AT = f"timestamp '{D.AS_OF}'"


def latest_per_key(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return sessions.latest(e, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


SQL_LATEST = "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1"


def resume_session(spark, d):
    r = sessions.resume(D.sessions(spark, d), D.checkpoints(spark, d), ["workspace_key", "operator_id"])
    return r.select("workspace_key", "operator_id", "session_id", "status", "checkpoint_id", "checkpointed_at")


SQL_RESUME = f"""with {D.SQL_SESSIONS}, {D.SQL_CHECKPOINTS},
s as (select * from sessions where status in ('open', 'parked') qualify row_number() over (partition by workspace_key, operator_id order by (status = 'open') desc, updated_at desc, session_id desc) = 1),
c as (select session_id, checkpoint_id, created_at as checkpointed_at from checkpoints qualify row_number() over (partition by session_id order by created_at desc, checkpoint_id desc) = 1)
select workspace_key, operator_id, s.session_id, status, checkpoint_id, checkpointed_at from s left join c on c.session_id = s.session_id"""


def heartbeats(spark, d):
    return sessions.heartbeats(D.beats(spark, d))


_HOSTS = (
    f"{D.SQL_BEATS}, hosts as (select session_id, host, min(ts) as first_seen_at, max(ts) as last_seen_at, arg_max(ide, ts) as "
    f"ide from beats group by 1, 2)"
)
SQL_BEATS = f"with {_HOSTS} select * from hosts"


def live_hosts(spark, d):
    return sessions.live_hosts(heartbeats(spark, d), D.as_of(), 1440, but="h1").select("session_id", "host", "last_seen_at")


SQL_LIVE = f"with {_HOSTS} select session_id, host, last_seen_at from hosts where last_seen_at >= {_AT} - interval 1440 minute and host <> 'h1'"


def liveness_spells(spark, d):
    return live.liveness(D.beats(spark, d), 240)


SQL_SPELLS = f"""with {D.SQL_BEATS}, g as (select *, case when ts >= lag(ts) over w + interval 240 minute then 1 else 0 end as cut from beats window w as (partition by session_id, host order by ts)),
s as (select *, sum(cut) over (partition by session_id, host order by ts rows unbounded preceding) as spell from g)
select session_id, host, min(ts) as first_seen_at, max(ts) as last_seen_at, count(*) as beats from s group by session_id, host, spell"""


def activity_windows(spark, d):
    return live.activity(table(spark, d, "events"), "6 hours").select("start", "event_type", "n", F.round("total", 4).alias("total"))


SQL_ACTIVITY = (
    "select time_bucket(interval 6 hour, ts, timestamp '1970-01-01') as start, event_type, count(*) as n, round(sum(value), 4) "
    "as total from events group by 1, 2"
)


def implied_activity(spark, d):
    return sessions.implied_activity(D.sessions(spark, d), D.as_of(), 2880).select("session_id")


SQL_IMPLIED = (
    f"with {D.SQL_SESSIONS} select session_id from sessions where greatest(coalesce(last_checkpoint_at, updated_at), updated_at) "
    f">= {_AT} - interval 2880 minute"
)


def other_lanes(spark, d):
    return sessions.other_lanes(D.sessions(spark, d), "default", D.as_of()).select("session_id", "idle_hours", "stale")


SQL_LANES = (
    f"with {D.SQL_SESSIONS}, o as (select session_id, date_sub('hour', greatest(coalesce(last_checkpoint_at, updated_at), updated_at), "
    f"{_AT}) as idle_hours from sessions where status = 'open' and lane <> 'default') select *, idle_hours >= 72 as stale from "
    f"o"
)


def hours_since_checkpoint(spark, d):
    return sessions.hours_since_checkpoint(D.checkpoints(spark, d), D.as_of())


SQL_HOURS = (
    f"with {D.SQL_CHECKPOINTS} select session_id, date_sub('minute', max(created_at), {_AT}) / 60.0::double as hours from checkpoints "
    f"group by session_id"
)


def host_switch(spark, d):
    h = heartbeats(spark, d)
    live_ = sessions.live_hosts(h, D.as_of(), 1440, but="h1").select("session_id").distinct().withColumn("live", F.lit(True))
    last = h.groupBy("session_id").agg(F.max_by("host", F.struct("last_seen_at", "host")).alias("host"))
    return last.join(live_, "session_id", "left").select("session_id", sessions.host_switch(F.coalesce("live", F.lit(False)), F.col("host"), F.lit("h1")).alias("switch"))


SQL_SWITCH = f"""with {_HOSTS}, l as (select distinct session_id from hosts where last_seen_at >= {_AT} - interval 1440 minute and host <> 'h1'),
n as (select session_id, host from hosts qualify row_number() over (partition by session_id order by last_seen_at desc, host desc) = 1)
select n.session_id, case when l.session_id is not null then 'contention' when host <> 'h1' then 'handoff' else 'none' end as switch from n left join l using (session_id)"""


def decisions_superseded(spark, d):
    return sessions.decisions(D.checkpoints(spark, d)).select("checkpoint_id", "decision", "superseded_by")


SQL_DECISIONS = f"""with {D.SQL_CHECKPOINTS}, o as (select supersedes, arg_max(checkpoint_id, created_at) as superseded_by from checkpoints where supersedes is not null group by 1)
select checkpoint_id, decision, superseded_by from checkpoints left join o on o.supersedes = checkpoint_id where decision is not null"""


def _aliases(spark, d):
    n = table(spark, d, "nation").filter("n_nationkey % 4 = 1")
    return n.select(F.concat(F.lit("w"), F.col("n_nationkey")).alias("alias_key"), F.concat(F.lit("w"), F.col("n_nationkey") - 1).alias("canonical_key"))


_ALIAS = "aliases as (select 'w' || n_nationkey as alias_key, 'w' || (n_nationkey - 1) as canonical_key from nation where n_nationkey % 4 = 1)"


def alias_resolve(spark, d):
    return sessions.resolve_alias(D.sessions(spark, d), _aliases(spark, d)).groupBy("workspace_key").agg(F.count("*").alias("n"))


SQL_ALIAS = (
    f"with {D.SQL_SESSIONS}, {_ALIAS} select coalesce(canonical_key, workspace_key) as workspace_key, count(*) as n from sessions "
    f"left join aliases on alias_key = workspace_key group by 1"
)


def alias_refusals(spark, d):
    c = table(spark, d, "nation")
    k = F.col("n_nationkey")
    proposed = c.select(F.concat(F.lit("w"), k).alias("alias_key"), F.concat(F.lit("w"), F.when(k % 5 == 0, k).otherwise(k + 1)).alias("canonical_key"))
    return sessions.alias_refusals(proposed, _aliases(spark, d))


SQL_REFUSALS = f"""with {_ALIAS}, p as (select 'w' || n_nationkey as alias_key, 'w' || (case when n_nationkey % 5 = 0 then n_nationkey else n_nationkey + 1 end) as canonical_key from nation)
select *, case when alias_key = canonical_key then 'self' when canonical_key in (select alias_key from aliases) then 'chained' when alias_key in (select alias_key from aliases) then 'existing' end as refusal from p"""


def open_collision(spark, d):
    return sessions.open_collisions(D.sessions(spark, d), _aliases(spark, d)).select("alias_session", "canonical_session", "workspace_key")


SQL_COLLISION = f"""with {D.SQL_SESSIONS}, {_ALIAS} select a.session_id as alias_session, b.session_id as canonical_session, canonical_key as workspace_key from sessions a join aliases on alias_key = a.workspace_key
join sessions b on b.workspace_key = canonical_key and b.agent_id = a.agent_id and b.operator_id = a.operator_id and b.lane = a.lane where a.status = 'open' and b.status = 'open' and a.session_id <> b.session_id"""


def duplicate_open(spark, d):
    return sessions.duplicate_open(D.sessions(spark, d))


SQL_DUPLICATE_OPEN = (
    f"with {D.SQL_SESSIONS} select sha256(concat_ws(chr(10), agent_id, operator_id, workspace_key, lane)) as open_key, count(*) "
    f"as n from sessions where status = 'open' group by 1 having count(*) > 1"
)


def lineage(spark, d):
    last = table(spark, d, "customer").agg(F.max("c_custkey").alias("m")).first()["m"]
    return graph.lineage(spark, D.sessions(spark, d).select("session_id", "parent_session_id"), last)


SQL_LINEAGE = f"""with recursive {D.SQL_SESSIONS}, up as (select session_id, parent_session_id, 0 as depth from sessions where session_id = (select max(c_custkey) from customer)
union all select s.session_id, s.parent_session_id, up.depth + 1 from up join sessions s on s.session_id = up.parent_session_id) select * from up"""


def session_tree(spark, d):
    return sessions.tree(D.sessions(spark, d)).select("session_id", "root", "depth")


SQL_TREE = f"""with recursive {D.SQL_SESSIONS}, own as (select s.session_id, p.session_id as up from sessions s left join sessions p on p.session_id = s.parent_session_id and p.workspace_key = s.workspace_key),
down as (select session_id, session_id as root, 0::bigint as depth from own where up is null union all select o.session_id, down.root, down.depth + 1 from down join own o on o.up = down.session_id) select * from down"""


def children(spark, d):
    return D.sessions(spark, d).filter("parent_session_id = 7").orderBy("updated_at", "session_id").select("session_id", "updated_at")


SQL_CHILDREN = f"with {D.SQL_SESSIONS} select session_id, updated_at from sessions where parent_session_id = 7"


def workspaces(spark, d):
    return sessions.workspaces(D.sessions(spark, d))


SQL_WORKSPACES = f"with {D.SQL_SESSIONS}, n as (select * from sessions order by updated_at desc, session_id limit 200) select distinct workspace_key from n"


def filtered_sessions(spark, d):
    return sessions.matching(D.sessions(spark, d), agent_id="a1", operator_id="", status="open", lane=None).select("session_id", "operator_id")


SQL_FILTERED = f"with {D.SQL_SESSIONS} select session_id, operator_id from sessions where agent_id = 'a1' and status = 'open'"


def paged_listing(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return sessions.page(o, [F.desc("o_orderdate"), F.col("o_orderkey")], limit="25", offset=50)


SQL_PAGED = "select o_orderkey, o_orderdate, o_totalprice from orders order by o_orderdate desc, o_orderkey limit 25 offset 50"


def filtered_count(spark, d):
    return sessions.matching(table(spark, d, "orders"), o_orderstatus="F", o_orderpriority=None).agg(F.count("*").alias("n"))


SQL_COUNT = "select count(*) as n from orders where o_orderstatus = 'F'"


def job_summary(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("status"), F.when(F.col("event_id") % 4 > 0, F.round("value", 2).cast("decimal(12,2)")).alias("score"))
    return jobs.run_summary(e).select("status", "n", F.round("avg_score", 6).alias("avg_score"))


SQL_JOBS = """with i as (select event_type as status, case when event_id % 4 > 0 then cast(cast(round(value, 2) as decimal(12,2)) as double) end as score from events)
select coalesce(status, 'total') as status, count(*) as n, round(avg(score), 6) as avg_score from i group by rollup (status)"""


def job_events(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id", "event_type")
    return sessions.with_seq(e).select("run_id", "seq", "event_id", "event_type")


SQL_EVENTS = "select user_id as run_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) as seq, event_id, event_type from events"


def item_fold(spark, d):
    e = table(spark, d, "events")
    log = e.select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("status"), F.when(F.col("event_id") % 5 == 0, F.col("value")).alias("score"), F.when(F.col("event_type") == "error", F.col("props")).alias("error_text"), (F.col("event_type") == "signup").alias("bump"))
    return jobs.fold_items(log)


SQL_FOLD = """select user_id as item, arg_max(event_type, event_id) filter (event_id % 3 = 0) as status, arg_max(value, event_id) filter (event_id % 5 = 0) as score,
arg_max(props, event_id) filter (event_type = 'error') as error_text, count(*) filter (event_type = 'signup') as attempt from events group by 1"""


def _snapshots(spark, d):
    docs = table(spark, d, "documents")
    new = docs.filter("doc_id % 11 <> 0").select("doc_id", F.sha2("text", 256).alias("content_sha256"))
    old = docs.filter("doc_id % 13 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("old "), F.col("text"))).otherwise(F.col("text")), 256).alias("content_sha256"), (F.col("doc_id") % 5 != 0).alias("has_vector"))
    return new, old


_SNAPS = """new as (select doc_id, sha256(text) as h from documents where doc_id % 11 <> 0),
old as (select doc_id, sha256(case when doc_id % 7 = 0 then 'old ' || text else text end) as h, doc_id % 5 <> 0 as has_vector from documents where doc_id % 13 <> 0),
diff as (select coalesce(new.doc_id, old.doc_id) as doc_id, case when new.doc_id is null then 'delete' when old.doc_id is null then 'insert' when new.h <> old.h then 'update' when not has_vector then 'embed' else 'unchanged' end as action
  from new full join old on new.doc_id = old.doc_id)"""


def incremental_diff(spark, d):
    return merging.diff_by_key(*_snapshots(spark, d), ["doc_id"], has_vector="has_vector")


SQL_DIFF = f"with {_SNAPS} select * from diff"


def diff_summary(spark, d):
    return merging.summary(incremental_diff(spark, d))


SQL_SUMMARY = f"with {_SNAPS} select action, count(*) as n from diff group by 1"


def drift_report(spark, d):
    new, old = _snapshots(spark, d)
    return merging.drift(new, old, "doc_id")


SQL_DRIFT = f"""with {_SNAPS} select doc_id, 'stale' as problem from old where doc_id not in (select doc_id from new) union all select doc_id, 'missing' from new where doc_id not in (select doc_id from old)
union all select new.doc_id, 'drifted' from new join old on new.doc_id = old.doc_id where new.h <> old.h union all select new.doc_id, 'no_embedding' from new join old on new.doc_id = old.doc_id where not has_vector"""


def scd2_merge(spark, d):
    p = table(spark, d, "part")
    h = F.sha2(F.concat_ws("|", "p_name", "p_brand"), 256)
    start = F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")
    history = p.filter("p_partkey % 7 <> 3").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.lit("before")).otherwise(F.col("p_name")).alias("title"), F.when(F.col("p_partkey") % 5 == 0, F.lit("x")).otherwise(h).alias("content_hash"), start.alias("valid_from"), F.when(F.col("p_partkey") % 9 == 0, start).alias("superseded_at"))
    targets = p.filter("p_partkey % 4 <> 1").select("p_partkey", F.col("p_name").alias("title"), h.alias("content_hash"))
    return merging.scd2_merge(history, targets, "p_partkey", D.as_of(), keep=F.col("p_partkey") % 8 == 1)


SQL_SCD2 = f"""with h as (select p_partkey, case when p_partkey % 5 = 0 then 'before' else p_name end as title, case when p_partkey % 5 = 0 then 'x' else sha256(p_name || '|' || p_brand) end as content_hash,
  timestamp '2023-01-01' as valid_from, case when p_partkey % 9 = 0 then timestamp '2023-01-01' end as superseded_at from part where p_partkey % 7 <> 3),
t as (select p_partkey, p_name as title, sha256(p_name || '|' || p_brand) as content_hash from part where p_partkey % 4 <> 1),
cur as (select * from h where superseded_at is null)
select * from h where superseded_at is not null
union all select c.p_partkey, c.title, c.content_hash, c.valid_from, case when t.content_hash = c.content_hash or (t.p_partkey is null and c.p_partkey % 8 = 1) then null else {_AT} end from cur c left join t using (p_partkey)
union all select t.p_partkey, t.title, t.content_hash, {_AT}, null from t left join cur c using (p_partkey) where c.content_hash is distinct from t.content_hash"""


def upsert_transcripts(spark, d):
    c = table(spark, d, "conversations")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    g = c.groupBy("conv_id").agg(F.sha2(body, 256).alias("h"))
    ref, k = F.col("conv_id").cast("string").alias("source_ref"), F.col("conv_id")
    at = lambda s: F.lit(s).cast("timestamp_ntz").alias("captured_at")
    captured = g.filter("conv_id % 5 <> 0").select(F.lit("a").alias("source_host"), ref, F.col("h").alias("content_sha256"), F.when(k % 2 == 0, k).alias("session_id"), at("2024-02-01 00:00:00"), F.concat(F.lit("new "), k).alias("title"))
    stored = g.filter("conv_id % 3 <> 0").select(F.lit("a").alias("source_host"), ref, F.when(k % 4 == 0, F.lit("old")).otherwise(F.col("h")).alias("content_sha256"), F.when(k % 7 == 0, k).alias("session_id"), at("2024-01-01 00:00:00"), F.concat(F.lit("old "), k).alias("title"), F.when(k % 8 == 0, "user").otherwise("derived").alias("title_source"))
    return merging.upsert_transcripts(stored, captured)


SQL_UPSERT = """with g as (select conv_id, sha256(string_agg(text, chr(10) order by turn)) as h from conversations group by 1),
c as (select conv_id, h, case when conv_id % 2 = 0 then conv_id end as session_id from g where conv_id % 5 <> 0),
s as (select conv_id, case when conv_id % 4 = 0 then 'old' else h end as h, case when conv_id % 7 = 0 then conv_id end as session_id, case when conv_id % 8 = 0 then 'user' else 'derived' end as ts from g where conv_id % 3 <> 0),
j as (select coalesce(c.conv_id, s.conv_id) as k, c.h as ch, s.h as sh, c.session_id as cs, s.session_id as ss, ts, c.conv_id is not null and (s.h is null or c.h <> s.h) as changed, c.conv_id is not null as came from c full join s on c.conv_id = s.conv_id)
select 'a' as source_host, cast(k as varchar) as source_ref, coalesce(ch, sh) as content_sha256, case when changed then coalesce(cs, ss) else ss end as session_id,
  case when came then timestamp '2024-02-01' else timestamp '2024-01-01' end as captured_at,
  case when changed and ts is distinct from 'user' then 'new ' || k else 'old ' || k end as title,
  case when changed and ts is distinct from 'user' then 'derived' else ts end as title_source, changed from j"""


def insert_ignore(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return append_missing(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 3 = 0").withColumn("lang", F.lit("new")), "doc_id")


SQL_INSERT_IGNORE = (
    "select doc_id, lang from documents where doc_id % 2 = 0 union all select doc_id, 'new' from documents where doc_id % 3 = "
    "0 and doc_id % 2 <> 0"
)


def corpus_fingerprint(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return merging.fingerprint(docs, "doc_id", "h")


SQL_FINGERPRINT = "select count(*) as n, bit_xor(cast('0x' || substr(sha256(doc_id || ':' || sha256(text)), 1, 15) as bigint)) as checksum from documents"

_F = (
    latest_per_key, resume_session, heartbeats, live_hosts, liveness_spells, activity_windows, implied_activity, other_lanes,
    hours_since_checkpoint, host_switch, decisions_superseded, alias_resolve, alias_refusals, open_collision, duplicate_open, lineage,
    session_tree, children, workspaces, filtered_sessions, paged_listing, filtered_count, job_summary, job_events, item_fold,
    incremental_diff, diff_summary, drift_report, scd2_merge, upsert_transcripts, insert_ignore, corpus_fingerprint,
)
QUERIES = {f.__name__: f for f in _F}
SQL = dict(zip(
    (f.__name__ for f in _F),
    (
        SQL_LATEST, SQL_RESUME, SQL_BEATS, SQL_LIVE, SQL_SPELLS, SQL_ACTIVITY, SQL_IMPLIED, SQL_LANES, SQL_HOURS, SQL_SWITCH,
        SQL_DECISIONS, SQL_ALIAS, SQL_REFUSALS, SQL_COLLISION, SQL_DUPLICATE_OPEN, SQL_LINEAGE, SQL_TREE, SQL_CHILDREN, SQL_WORKSPACES,
        SQL_FILTERED, SQL_PAGED, SQL_COUNT, SQL_JOBS, SQL_EVENTS, SQL_FOLD, SQL_DIFF, SQL_SUMMARY, SQL_DRIFT, SQL_SCD2, SQL_UPSERT,
        SQL_INSERT_IGNORE, SQL_FINGERPRINT,
    ),
    strict=True,
))
