"""Upkeep of tables and graphs, summaries of hosts' inputs, schema rules and rendered reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import batching, graph, indexing, jobs, merging, quality, reports, sessions
from tessera.plans import derive as D
from tessera.plans import graphs as G
from tessera.plans import lifecycle as L
from tessera.sources import knowledge
from tessera.sources.tables import table


def _k():
    return F.col("p_partkey")


def _mod(n: int):
    return F.pmod(_k(), F.lit(n))


def structural_replaced(spark, d):
    """Structural edges are replaced, new ones of curated pairs win; all others stay, also those without a graph."""
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src_id"), F.col("l_suppkey").alias("dst_id"), F.col("l_returnflag").alias("edge_type")).distinct()
    old = li.withColumn("graph", F.when(F.col("src_id") % 3 == 0, "structural").when(F.col("src_id") % 3 == 1, "domain"))
    return graph.replace_edges(old, li.filter("dst_id % 2 = 0").withColumn("graph", F.lit(None).cast("string")), structural=True)


SQL_STRUCTURAL = """with e as (select distinct l_partkey as src_id, l_suppkey as dst_id, l_returnflag as edge_type from lineitem)
select src_id, dst_id, edge_type, case when src_id % 3 = 1 then 'domain' end as graph from e where src_id % 3 <> 0 and dst_id % 2 <> 0
union all select src_id, dst_id, edge_type, 'structural' from e where dst_id % 2 = 0"""


def diff_applied(spark, d):
    """A table after its diff: odd parts changed, each fifth is new, each seventh is gone."""
    p = table(spark, d, "part")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    old = p.filter("p_partkey % 5 <> 0").select(_k().alias("id"), F.sha2("p_name", 256).alias("content_sha256"), start.alias("created_at"), start.alias("updated_at"))
    new = p.filter("p_partkey % 7 <> 0").select(_k().alias("id"), F.sha2(F.concat("p_name", F.when(_mod(2) == 1, "!").otherwise("")), 256).alias("content_sha256"))
    return merging.apply_diff(new, old, ["id"], now=D.as_of())


SQL_APPLIED = f"""select p_partkey as id, sha256(p_name || case when p_partkey % 2 = 1 then '!' else '' end) as content_sha256,
case when p_partkey % 5 = 0 then timestamp '{D.AS_OF}' else timestamp '2024-01-01' end as created_at,
case when p_partkey % 5 = 0 or p_partkey % 2 = 1 then timestamp '{D.AS_OF}' else timestamp '2024-01-01' end as updated_at from part where p_partkey % 7 <> 0"""


def stub_repair(spark, d):
    """Stubs that name another document than their id does, or none."""
    named = F.when(_mod(3) == 0, _k().cast("string")).when(_mod(3) == 1, F.lit("x"))
    nodes = table(spark, d, "part").select(
        F.concat(F.lit("stub-"), _k()).alias("node_id"), F.when(_mod(4) > 0, "docshare-stub").otherwise("domain").alias("graph"), F.to_json(F.struct(F.lit("stub").alias("tier"), named.alias("docshare_doc_id"))).alias("attributes")
    )
    done = graph.repair_stub_docs(nodes)
    return done.select("node_id", F.get_json_object("attributes", "$.docshare_doc_id").alias("document"), F.get_json_object("attributes", "$.tier").alias("tier"))


SQL_REPAIR = """select 'stub-' || p_partkey as node_id, case when p_partkey % 4 > 0 or p_partkey % 3 = 0 then p_partkey::varchar when p_partkey % 3 = 1 then 'x' end as document, 'stub' as tier from part"""


def tool_inputs(spark, d):
    """Arguments of tools: short ones whole, long ones cut by value and then in all."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    pairs = F.array(pair("name", F.col("p_name")), pair("body", F.repeat(F.concat("p_name", F.lit(" \n ")), _mod(30).cast("int"))), pair("more", F.repeat("p_type", _mod(41).cast("int"))), pair("last", F.repeat("p_brand", F.lit(50))))
    return table(spark, d, "part").select("p_partkey", T.summarise_tool_input(pairs).alias("summary"))


SQL_TOOLS = r"""with v as (select p_partkey, unnest([{'n': 1, 'k': 'name', 'v': p_name}, {'n': 2, 'k': 'body', 'v': repeat(p_name || ' ', (p_partkey % 30)::int)}, {'n': 3, 'k': 'more', 'v': repeat(p_type, (p_partkey % 41)::int)}, {'n': 4, 'k': 'last', 'v': repeat(p_brand, 50)}]) as x from part),
f as (select p_partkey, x.n as n, x.k as k, trim(regexp_replace(x.v, '\s+', ' ', 'g'), ' ') as v from v),
s as (select p_partkey, string_agg(k || '=' || case when length(v) > 200 then substr(v, 1, 200) || '… (+' || (length(v) - 200) || ' chars)' else v end, ', ' order by n) as s from f group by 1)
select p_partkey, case when length(s) > 600 then substr(s, 1, 600) || '…' else s end as summary from s"""


def vcs_lines(spark, d):
    """Porcelain states of up to 59 paths, with renames and sensitive names."""
    line = lambda i: F.when(i % 7 == 0, F.concat(F.lit("R  old/f"), i, F.lit(" -> new/f"), i)).when(i % 11 == 0, F.concat(F.lit("?? keys/k"), i, F.lit(".pem"))).when(i % 13 == 0, F.lit(" M .env.local")).otherwise(F.concat(F.lit(" M src/f"), i))
    status = F.array_join(F.transform(F.sequence(F.lit(1), _mod(60).cast("int") + 1), line), "\n")
    return table(spark, d, "part").select("p_partkey", T.vcs_summary(status).alias("summary"))


SQL_VCS = r"""with l as (select p_partkey, unnest(range(1, p_partkey % 60 + 2)) as i from part),
n as (select p_partkey, i, (i % 7 = 0 or (i % 11 > 0 and i % 13 > 0)) as open_, case when i % 7 = 0 then 'R  old/f' || i || ' -> new/f' || i else ' M src/f' || i end as line from l),
r as (select *, case when open_ then count(*) filter (open_) over (partition by p_partkey order by i) end as k from n),
t as (select p_partkey, string_agg(line, chr(10) order by i) filter (k <= 40) as shown, count(*) filter (k > 40) as more, count(*) filter (not open_) as hidden from r group by 1)
select p_partkey, concat_ws(chr(10), shown, case when more > 0 then '... and ' || more || ' more changed path(s)' end, case when hidden > 0 then '[' || hidden || ' sensitive path(s) withheld]' end) as summary from t"""


def sensitive_paths(spark, d):
    kinds = F.array(*map(F.lit, ("a/.ssh/config", ".env", "src/.env.prod", "x/secret/y", "docs/secrets.md", "k/ID_RSA", "credentials.yml", "my.credentials", "a.pem/b", "b.JKS")))
    path = F.element_at(kinds, (_mod(10) + 1).cast("int"))
    return table(spark, d, "part").filter(T.is_sensitive_path(path)).groupBy(path.alias("path")).agg(F.count("*").alias("n"))


SQL_SENSITIVE = """with p as (select ['a/.ssh/config', '.env', 'src/.env.prod', 'x/secret/y', 'docs/secrets.md', 'k/ID_RSA', 'credentials.yml', 'my.credentials', 'a.pem/b', 'b.JKS'][p_partkey % 10 + 1] as path, p_partkey % 10 as k from part)
select path, count(*) as n from p where k not in (4, 7, 8) group by 1"""


def fresh_items(spark, d):
    """Items that a run can skip, by status."""
    status = F.element_at(F.array(F.lit("qc_passed"), F.lit("completed"), F.lit("failed"), F.lit(None).cast("string")), (_mod(4) + 1).cast("int"))
    stored = F.when(_mod(5) > 0, F.sha2("p_name", 256))
    now = F.when(_mod(7) > 0, F.sha2(F.concat("p_name", F.when(_mod(6) == 0, "!").otherwise("")), 256))
    return table(spark, d, "part").select(status.alias("status"), jobs.is_fresh(status, stored, now).alias("fresh")).groupBy("status", "fresh").agg(F.count("*").alias("n"))


SQL_FRESH = """select ['qc_passed', 'completed', 'failed', null][p_partkey % 4 + 1] as status, p_partkey % 4 < 2 and p_partkey % 5 > 0 and p_partkey % 7 > 0 and p_partkey % 6 > 0 as fresh, count(*) as n from part group by 1, 2"""


def stale_sessions(spark, d):
    """Whether an automatic checkpoint is due: none for 24 hours, or none ever."""
    hours = sessions.hours_since_checkpoint(D.checkpoints(spark, d), D.as_of())
    return D.sessions(spark, d).select("session_id").join(hours, "session_id", "left").select("session_id", sessions.is_stale(F.col("hours"), 24.0).alias("stale"))


SQL_STALE = f"""with {D.SQL_SESSIONS}, {D.SQL_CHECKPOINTS}, h as (select session_id, max(created_at) as last from checkpoints group by 1)
select s.session_id, coalesce(floor(epoch(timestamp '{D.AS_OF}' - last) / 60) / 60.0 >= 24, true) as stale from sessions s left join h using (session_id)"""


def embedding_costs(spark, d):
    """What embedding all chunks costs, by granularity."""
    return D.chunks(spark, d).groupBy("granularity").agg(F.count("*").alias("n")).select("granularity", "n", F.round(jobs.embedding_cost(F.col("n")), 9).alias("dollars"))


SQL_COSTS = f"with {D.SQL_CHUNKS} select granularity, count(*) as n, round(count(*) * 150 / 1000000.0 * 0.02, 9) as dollars from chunks group by 1"


def presentations(spark, d):
    """Titles by locale: unknown locales and blank texts go, as do presentations of which nothing is left."""
    title = F.create_map(F.lit("en"), F.concat(F.lit("  "), "p_name", F.lit("\n x ")), F.lit("fr"), F.col("p_name"), F.lit("es"), F.when(_mod(3) == 0, " ").otherwise(F.col("p_brand")))
    some = F.when(_mod(2) == 0, title)
    shown = indexing.normalise_presentation(some, F.when(_mod(5) == 0, F.create_map(F.lit("original"), F.col("p_type"))), F.lit(None).cast("map<string,map<string,array<string>>>"))
    rows = table(spark, d, "part").select("p_partkey", shown.alias("s")).filter("s is not null")
    return rows.select("p_partkey", F.col("s.title")["en"].alias("en"), F.col("s.title")["es"].alias("es"), F.col("s.title")["fr"].alias("fr"), F.col("s.description")["original"].alias("original"))


SQL_PRESENTATIONS = """select p_partkey, case when p_partkey % 2 = 0 then p_name || ' x' end as en, case when p_partkey % 2 = 0 and p_partkey % 3 > 0 then p_brand end as es, null::varchar as fr,
case when p_partkey % 5 = 0 then p_type end as original from part where p_partkey % 2 = 0 or p_partkey % 5 = 0"""


def contents_built(spark, d):
    """Chunk contents from Markdown bodies of 30 characters or more, else from the item itself."""
    body = F.when(_mod(3) > 0, F.repeat("p_name", (_mod(4) + 1).cast("int")))
    item = F.concat(F.lit('{"id": "'), _k(), F.lit('"}'))
    return table(spark, d, "part").select("p_partkey", knowledge.content_of(F.col("p_name"), body, item).alias("c")).select("p_partkey", "c.*")


SQL_CONTENTS = """with b as (select *, case when p_partkey % 3 > 0 then repeat(p_name, (p_partkey % 4 + 1)::int) end as body from part)
select p_partkey, p_name || chr(10) || chr(10) || case when length(body) >= 30 then body else '{"id": "' || p_partkey || '"}' end as content, case when length(body) >= 30 then 'markdown' else 'json' end as content_source from b"""


def _raw(spark, d):
    k = _k().cast("string")
    links = F.concat(F.lit('{"id": "n'), k, F.lit('", "related_to": ["n'), (_k() + 1).cast("string"), F.lit('", ""], "contains": ["n'), (_k() * 10).cast("string"), F.lit('"], "from": "n'), k)
    ends = F.when(_mod(3) == 0, '", "to": "t"}').when(_mod(3) == 1, '", "dst_id": "u", "edge_type": "uses"}').otherwise('", "name": "x"}')
    return table(spark, d, "part").select(F.concat(links, ends).alias("item"), F.when(_mod(2) == 0, "domain").otherwise("builder").alias("graph"))


def emitted_edges(spark, d):
    """Edges of the items' list fields and of explicit edge records."""
    raw = _raw(spark, d)
    return graph.edge_rows(raw).unionByName(graph.listed_edges(raw))


SQL_EMITTED = """with p as (select *, case when p_partkey % 2 = 0 then 'domain' else 'builder' end as graph, 'n' || p_partkey as id from part)
select id as src_id, 'n' || (p_partkey + 1) as dst_id, 'related_to' as edge_type, graph from p union all select id, 'n' || (p_partkey * 10), 'contains', graph from p
union all select id, 't', 'related', graph from p where p_partkey % 3 = 0 union all select id, 'u', 'uses', graph from p where p_partkey % 3 = 1"""


def schema_findings(spark, d):
    """Files of each kind, each with one fault or none."""
    k, at = F.lit("k"), _mod(8)

    def file(kind: str, items: str, faults: list[str]):
        head = '{"graphType": "%s", "role": "role-a", "generatedAt": "2024-01-01", "project": "p", "version": "1", %s}'
        texts = [head % (kind, items), "{bad", head.replace("role-a", "other") % (kind, items), *(head % (kind, f) for f in faults)]
        texts += [texts[0]] * (8 - len(texts))
        rows = table(spark, d, "part").select(F.concat(F.lit(f"{kind}/"), _k()).alias("path"), F.element_at(F.array(*map(F.lit, texts)), (at + 1).cast("int")).alias("value"))
        return quality.schema_findings(rows, kind).groupBy(k.alias("kind"), "finding").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))

    out = file("skills", '"skills": [{"id": "a"}]', ['"x": 1', '"skills": [{"id": ""}]', '"skills": [{"id": "a", "type": ""}]', '"skills": [{"id": "a", "name": ""}]'])
    out = out.unionByName(file("behaviors", '"behaviors": [{"id": "a", "priority": "high"}]', ['"behaviors": [{"id": "a", "priority": "urgent"}]', '"behaviors": [{"type": "x"}]']))
    out = out.unionByName(file("knowledge", '"nodes": [{"id": ""}]', ['"nodes": [], "documents": []', '"documents": [{"id": "a", "type": ""}]', '"documents": [{"type": "a"}]']))
    roles = '"roles": [{"id": "%s", "name": "n", "graphs": [{"id": "g", "path": "%s"}]}]'
    return out.unionByName(file("master", roles % ("role-a", "agents/knowledge-graphs/a.json"), [roles % ("a", "agents/knowledge-graphs/a"), roles % ("role-a", "x/a"), '"roles": [{"id": "role-a", "graphs": [{"path": "agents/knowledge-graphs/b"}]}]']))


SQL_SCHEMA = """with f(kind, slot, finding) as (values ('skills', 1, 'not JSON'), ('skills', 2, 'wrong role'), ('skills', 3, 'missing skills'), ('skills', 4, 'item without id'), ('skills', 5, 'empty type'), ('skills', 6, 'empty name'),
('behaviors', 1, 'not JSON'), ('behaviors', 2, 'wrong role'), ('behaviors', 3, 'unknown priority'), ('behaviors', 4, 'item without id'),
('knowledge', 1, 'not JSON'), ('knowledge', 2, 'wrong role'), ('knowledge', 3, 'not exactly one of nodes and documents'), ('knowledge', 4, 'empty type'), ('knowledge', 5, 'item without id'),
('master', 1, 'not JSON'), ('master', 3, 'wrong role id'), ('master', 4, 'graph outside its folder'), ('master', 5, 'role without id, name or graphs'), ('master', 5, 'graph without id or path'))
select kind, finding, count(*) as n from f join part on p_partkey % 8 = slot group by 1, 2"""


def resume_texts(spark, d):
    """What to read before each workspace's session goes on."""
    found = sessions.resume(D.sessions(spark, d), D.checkpoints(spark, d), ["workspace_key", "operator_id"])
    points = D.checkpoints(spark, d).select("checkpoint_id", "decisions", F.when(F.col("checkpoint_id") % 2 == 0, F.concat(F.lit("do "), "checkpoint_id")).alias("next_action"), (F.col("checkpoint_id") % 4 == 0).alias("auto"))
    return reports.resume_text(found.join(points, "checkpoint_id", "left").withColumn("title", F.when(F.col("session_id") % 2 == 0, F.col("operator_id"))))


SQL_RESUMED = f"""with {D.SQL_SESSIONS}, {D.SQL_CHECKPOINTS},
chosen as (select *, row_number() over (partition by workspace_key, operator_id order by (case when status = 'open' then 1 else 0 end) desc, updated_at desc, session_id desc) as n from sessions where status in ('open', 'parked')),
last as (select session_id, arg_max(checkpoint_id, (created_at, checkpoint_id)) as checkpoint_id, max(created_at) as made from checkpoints group by 1)
select c.session_id, concat_ws(chr(10), 'session: ' || c.session_id || ' (' || status || ')', 'workspace: ' || workspace_key, 'lane: ' || lane, case when c.session_id % 2 = 0 then 'title: ' || operator_id end, 'updated: ' || updated_at,
  case when l.checkpoint_id is null then 'no checkpoint yet' else 'checkpoint: ' || made || case when l.checkpoint_id % 4 = 0 then ' (automatic)' else '' end end,
  case when l.checkpoint_id % 2 = 0 then 'next action' || case when l.checkpoint_id % 4 = 0 then ' (carried forward)' else '' end || ': do ' || l.checkpoint_id end, 'decisions:' || chr(10) || '  - ' || p.decision) as body
from chosen c left join last l using (session_id) left join checkpoints p on p.checkpoint_id = l.checkpoint_id where n = 1"""


def lane_lines(spark, d):
    lanes = sessions.other_lanes(D.sessions(spark, d), "default", D.as_of())
    return reports.lane_lines(lanes.withColumn("title", F.when(F.col("session_id") % 2 == 0, F.col("operator_id"))))


SQL_LANE_LINES = f"""with {D.SQL_SESSIONS}, i as (select *, (epoch(timestamp '{D.AS_OF}' - greatest(coalesce(last_checkpoint_at, updated_at), updated_at))::bigint // 3600) as h from sessions where status = 'open' and lane <> 'default')
select session_id, lane || '  idle ' || case when h < 48 then h || 'h' else (h // 24) || 'd' end || '  ' || substr(session_id::varchar, 1, 8) || '  ' || case when session_id % 2 = 0 then operator_id else '(untitled)' end || case when h >= 72 then '  stale' else '' end as line from i"""


def tree_lines(spark, d):
    return reports.tree_lines(sessions.tree(D.sessions(spark, d)))


SQL_TREE_LINES = f"""select t.root, t.session_id, t.depth, repeat('  ', t.depth) || '- ' || t.session_id || ' ' || ['parked', 'open', 'open', 'closed'][t.session_id % 4 + 1] as line from ({L.SQL_TREE}) t"""


def switch_lines(spark, d):
    """What to ask where a session's machine changed or another one is live."""
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("h"), F.col("c_custkey") % 2)).alias("checkpoint_host"), F.lit("h0").alias("host"))
    return reports.switch_lines(e.withColumn("situation", sessions.host_switch(F.col("session_id") % 5 == 0, F.col("checkpoint_host"), F.col("host"))))


SQL_SWITCH_LINES = """select c_custkey as session_id, case when c_custkey % 5 = 0 then 'another machine is at work here, this one is h0: take another lane, or take over?' else 'last checkpoint on h1, now on h0: go on with the same session, or fork?' end as line
from customer where c_custkey % 5 = 0 or (c_custkey % 3 > 0 and c_custkey % 2 = 1)"""


def cjk_extracted(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("記録 a "), "lang", F.lit(" ひらカナ 한글"))).otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", T.cjk_runs(text).alias("runs"))


SQL_CJK = "select doc_id, case when doc_id % 3 = 0 then '記録 ひらカナ 한글' end as runs from documents"

def _synced(spark, d):
    """A first load of the graph: three of four documents and all hubs are curated."""
    paths = D.paths(spark, d)
    own = paths.filter("doc_id % 4 <> 0").select(F.col("doc_id").alias("pos"), F.to_json(F.struct(F.col("node_id").alias("id"), F.col("title").alias("name"), F.col("source_path").alias("path"))).alias("item"))
    hubs = D.hubs(spark, d).select(F.lit(0).cast("long").alias("pos"), F.to_json(F.struct(F.col("node_id").alias("id"))).alias("item"))
    items = own.unionByName(hubs).select(F.lit(0).alias("spec_no"), "pos", F.lit("domain").alias("graph"), F.lit("f.json").alias("source_file"), F.lit("skill").alias("default_type"), "item")
    history = spark.createDataFrame([], "node_id string, node_type string, graph string, title string, attributes string, source_path string, content_hash string, valid_from timestamp_ntz, superseded_at timestamp_ntz")
    edges = spark.createDataFrame([], "src_id string, dst_id string, edge_type string, graph string")
    return indexing.sync_graph(items, items.limit(0), paths.select("doc_id", F.col("source_path").alias("path"), "title"), history, edges, D.as_of())


def graph_sync_nodes(spark, d):
    return _synced(spark, d)["history"].select("node_id", "graph", "source_path", "superseded_at")


SQL_SYNC_NODES = f"""with {D.SQL_PATHS}, {D.SQL_HUBS}, n as (select node_id, 'domain' as graph, path as source_path from pathed where doc_id % 4 <> 0 union all select node_id, 'domain', null from hubs
union all select 'stub-' || doc_id, 'docshare-stub', path from pathed where doc_id % 4 = 0 and not starts_with(path, 'docs/plan/')) select *, null::timestamp as superseded_at from n"""


def graph_sync_edges(spark, d):
    return _synced(spark, d)["edges"]


def _synced_id(c):
    return f"case when regexp_matches({c}, '^n[0-9]+$') and try_cast(substr({c}, 2) as int) % 4 = 0 then 'stub-' || substr({c}, 2) else {c} end"


SQL_SYNC_EDGES = f"with {G.STRUCTURAL} select {_synced_id('src_id')} as src_id, {_synced_id('dst_id')} as dst_id, edge_type, 'structural' as graph from edges"


def graph_sync_coverage(spark, d):
    return _synced(spark, d)["coverage"]


SQL_SYNC_COVERAGE = f"""with {D.SQL_PATHS}, c as (select doc_id % 4 <> 0 or not starts_with(path, 'docs/plan/') as k, doc_id % 4 = 0 and not starts_with(path, 'docs/plan/') as stub from pathed)
select count(*) as total, count(*) filter (k) as linked, count(*) filter (not k) as unlinked, count(*) filter (stub) as stubs from c"""


def knowledge_chunks(spark, d):
    """Chunks of graph items, by their Markdown file if it is long enough; ids come twice and some items are archived."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("docs/"), k, F.lit(".md"))
    item = F.to_json(F.struct(F.concat(F.lit("n"), F.floor(k / 2).cast("long")).alias("id"), F.concat(F.lit("Title of "), k).alias("name"), F.when(k % 5 == 0, "Archived").alias("status"), F.concat(F.lit("./"), path).alias("path")))
    items = docs.select(F.pmod(k, F.lit(2)).cast("int").alias("spec_no"), k.alias("pos"), F.lit("kg:skill:").alias("prefix"), F.lit("skill").alias("default_type"), item.alias("item"))
    bodies = docs.filter(k % 3 == 0).select(path.alias("path"), F.col("text").alias("body"))
    got = knowledge.chunks(items, bodies)
    return got.select("id", "node_id", "node_type", "topic", "content_source", "content_sha256")


SQL_KNOWLEDGE = """with i as (select *, 'n' || (doc_id // 2) as node_id, 'Title of ' || doc_id as topic, doc_id % 3 = 0 and coalesce(length(text), 0) >= 30 as md from documents where doc_id % 5 <> 0),
c as (select *, topic || chr(10) || chr(10) || case when md then text else '{"id":"' || node_id || '","name":"' || topic || '","path":"./docs/' || doc_id || '.md"}' end as content from i)
select 'kg:skill:' || node_id as id, node_id, 'skill' as node_type, topic, case when md then 'markdown' else 'json' end as content_source, sha256(content) as content_sha256
from c qualify row_number() over (partition by node_id order by doc_id desc) = 1"""

def answers_repaired(spark, d):
    """A model's answers with every fault that can be mended, and some that can't."""
    k = _k().cast("string")
    parts = [('<think>a {</think>```json\n{"a": "', '"}\n```'), ('noise {"a": "', '\\q"} tail'), ('{"a": "', ""), ("none ", ""), ('{"a": {"b": ', "}"), ('{"a": "x\ny ', '"}')]
    texts = F.array(*(F.concat(F.lit(x), k, F.lit(y)) for x, y in parts))
    answer = F.element_at(texts, (_mod(6) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", batching.repair_json(F.when(_mod(7) > 0, answer))["a"].alias("a"))


SQL_REPAIRED = r"""select p_partkey, case when p_partkey % 7 > 0 then ['' || p_partkey, p_partkey || '\q', '' || p_partkey, null, '{"b":' || p_partkey || '}', 'x' || chr(10) || 'y ' || p_partkey][p_partkey % 6 + 1] end as a from part"""

_F = (
    structural_replaced, diff_applied, stub_repair, tool_inputs, vcs_lines, sensitive_paths, fresh_items, stale_sessions,
    embedding_costs, presentations, contents_built, emitted_edges, schema_findings, resume_texts, lane_lines, tree_lines,
    switch_lines, cjk_extracted, graph_sync_nodes, graph_sync_edges, graph_sync_coverage, knowledge_chunks, answers_repaired,
)
QUERIES = {f.__name__: f for f in _F}
SQL = dict(
    zip(
        QUERIES,
        (SQL_STRUCTURAL, SQL_APPLIED, SQL_REPAIR, SQL_TOOLS, SQL_VCS, SQL_SENSITIVE, SQL_FRESH, SQL_STALE, SQL_COSTS, SQL_PRESENTATIONS, SQL_CONTENTS, SQL_EMITTED, SQL_SCHEMA, SQL_RESUMED, SQL_LANE_LINES, SQL_TREE_LINES, SQL_SWITCH_LINES, SQL_CJK, SQL_SYNC_NODES, SQL_SYNC_EDGES, SQL_SYNC_COVERAGE, SQL_KNOWLEDGE, SQL_REPAIRED),
        strict=True,
    )
)
