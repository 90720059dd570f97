"""Queries over knowledge graphs: nodes, edges, stubs, integrity and metadata scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph, quality
from tessera.plans import derive as D
from tessera.sources.tables import table


def structural_edges(spark, d):
    docs = D.paths(spark, d)
    hubs = D.hubs(spark, d)
    return graph.structural_edges(docs, hubs)


STRUCTURAL = f"""{D.SQL_PATHS}, {D.SQL_HUBS}, r as (
  select node_id, case
    when starts_with(path, 'docs/projects/active/') and len(string_split(path, '/')) >= 4 then case when not ends_with(string_split(path, '/')[4], '.md') then ['doc:domain:projects:active:' || string_split(path, '/')[4] || ':index', 'belongs_to', 'path:projects/active'] end
    when starts_with(path, 'docs/architecture/') then ['cat-architecture', 'in_domain', 'path:architecture']
    when starts_with(path, 'agents/skills/') then ['skills-root', 'in_domain', 'path:agents/skills']
    when starts_with(path, 'agents/behaviors/') then ['behavior-root', 'in_domain', 'path:agents/behaviors'] end as r
  from pathed where not starts_with(path, 'docs/plan/')
), hit as (select r.node_id, r[1] as target, r[2] as edge_type, r[3] as provenance from r where r[1] in (select node_id from hubs)),
edges as (select node_id as src_id, target as dst_id, edge_type, provenance from hit union select target, node_id, 'contains', provenance from hit where edge_type = 'belongs_to')"""
SQL_STRUCTURAL = f"with {STRUCTURAL} select * from edges"


def edges_by_rule(spark, d):
    return structural_edges(spark, d).groupBy("provenance").agg(F.count("*").alias("n"))


SQL_BY_RULE = f"with {STRUCTURAL} select provenance, count(*) as n from edges group by 1"


def _lineitem_edges(spark, d):
    l = table(spark, d, "lineitem")
    return l.select(F.col("l_partkey").alias("src_id"), F.col("l_suppkey").alias("dst_id"), F.col("l_returnflag").alias("edge_type"), F.col("l_linestatus").alias("graph"))


def edge_dedupe(spark, d):
    return graph.dedupe_edges(_lineitem_edges(spark, d))


SQL_EDGE_DEDUPE = "select l_partkey as src_id, l_suppkey as dst_id, l_returnflag as edge_type, min(l_linestatus) as graph from lineitem group by 1, 2, 3"


def replace_edges(spark, d):
    """Curated edges are replaced; those marked structural, and those without a graph, stay."""
    e = graph.dedupe_edges(_lineitem_edges(spark, d))
    kind = F.when(F.col("src_id") % 3 == 0, "structural").when(F.col("src_id") % 3 == 1, "domain")
    new = e.filter("dst_id % 2 = 0").withColumn("graph", F.lit("domain"))
    return graph.replace_edges(e.withColumn("graph", kind), new, structural=False)


SQL_REPLACE = """with e as (select distinct l_partkey as src_id, l_suppkey as dst_id, l_returnflag as edge_type from lineitem),
u as (select *, case when src_id % 3 = 0 then 'structural' end as graph from e where src_id % 3 <> 1 union all select *, 'domain' from e where dst_id % 2 = 0)
select src_id, dst_id, edge_type, min(graph) as graph from u group by 1, 2, 3"""


def graph_expand(spark, d):
    """Nodes within two hops of the five first parts over part and supplier edges."""
    e = _lineitem_edges(spark, d)
    both = e.select(F.concat(F.lit("p"), "src_id").alias("src_id"), F.concat(F.lit("s"), "dst_id").alias("dst_id")).distinct()
    edges = both.unionByName(both.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id")))
    start = spark.range(5).select(F.concat(F.lit("p"), "id").alias("node_id"))
    return graph.expand(start, edges, 2)


SQL_EXPAND = """with e as (select distinct 'p' || l_partkey as a, 's' || l_suppkey as b from lineitem), x as (select a as s, b as t from e union all select b, a from e),
h0 as (select 'p' || i as node_id from range(5) r(i)), h1 as (select distinct t as node_id from x where s in (select node_id from h0)), h2 as (select distinct t as node_id from x where s in (select node_id from h1)),
u as (select node_id, 0 as hop from h0 union all select node_id, 1 from h1 union all select node_id, 2 from h2) select node_id, min(hop) as hop from u group by 1"""


def _curated(spark, d):
    p = D.paths(spark, d).filter("doc_id % 4 <> 0")
    return p.select("node_id", F.when(F.col("doc_id") % 9 == 0, "docshare-stub").otherwise("domain").alias("graph"), "source_path")


_CURATED = (
    "curated as (select node_id, case when doc_id % 9 = 0 then 'docshare-stub' else 'domain' end as graph, path as source_path "
    "from pathed where doc_id % 4 <> 0)"
)


def _shared_docs(spark, d):
    return D.paths(spark, d).select("doc_id", "title", F.col("source_path").alias("path"))


def stub_unlinked(spark, d):
    return graph.stub_nodes(graph.unlinked_docs(_shared_docs(spark, d), _curated(spark, d))).select("node_id", "title", "source_path", "graph")


SQL_UNLINKED = (
    f"with {D.SQL_PATHS}, {_CURATED} select 'stub-' || doc_id as node_id, title, path as source_path, 'docshare-stub' as graph "
    f"from pathed where not starts_with(path, 'docs/plan/') and path not in (select source_path from curated where graph <> 'docshare-stub')"
)


def stub_supersede(spark, d):
    """Stubs at paths of curated nodes; every curated path has a stub beside it here."""
    from tessera.functions.text import normalise_path

    c = _curated(spark, d).withColumn("source_path", normalise_path(F.col("source_path")))
    extra = c.filter("graph = 'domain'").select(F.concat(F.lit("stub-"), "node_id").alias("node_id"), F.lit("docshare-stub").alias("graph"), "source_path")
    return graph.stubs_to_supersede(c.unionByName(extra)).select("node_id", "source_path")


SQL_SUPERSEDE = f"with {D.SQL_PATHS}, {_CURATED} select 'stub-' || node_id as node_id, source_path from curated where graph = 'domain'"


def doc_backlink(spark, d):
    return graph.backlink(_shared_docs(spark, d), _curated(spark, d)).select("doc_id", "path", "kg_node_id", "kg_indexed")


_BACK = (
    f"{D.SQL_PATHS}, {_CURATED}, linked as (select doc_id, path, n as kg_node_id, n is not null as kg_indexed from pathed left "
    f"join (select source_path, max(node_id) as n from curated group by 1) on source_path = path)"
)
SQL_BACKLINK = f"with {_BACK} select * from linked"


def coverage(spark, d):
    return graph.coverage(graph.backlink(_shared_docs(spark, d), _curated(spark, d)), _curated(spark, d))


SQL_COVERAGE = (
    f"with {_BACK} select count(*) as total, count(*) filter (kg_indexed) as linked, count(*) filter (not kg_indexed) as unlinked, "
    f"(select count(*) from curated where graph = 'docshare-stub') as stubs from linked"
)


def integrity(spark, d):
    return quality.integrity(D.graph_nodes(spark, d), metadata_total=1)


_FINDINGS = f"""{D.SQL_NODES}, f as (
  select 'error' as severity, 'duplicate' as finding, id, cast(count(*) as varchar) as detail from nodes group by id having count(*) > 1
  union all select 'error', 'parent_not_found', id, parent from nodes where parent is not null and parent not in (select id from nodes)
  union all select 'error', 'child_not_found', id, child from nodes where child is not null and child not in (select id from nodes)
  union all select 'error', 'orphan', id, '' from nodes where type <> 'root' and parent is null
  union all select 'warning', 'metadata_count', null, cast(count(*) as varchar) from nodes having count(*) <> 1)"""
SQL_INTEGRITY = f"with {_FINDINGS} select * from f"


def integrity_summary(spark, d):
    return integrity(spark, d).groupBy("severity", "finding").agg(F.count("*").alias("n"))


SQL_INTEGRITY_SUMMARY = f"with {_FINDINGS} select severity, finding, count(*) as n from f group by 1, 2"


def orphans(spark, d):
    docs = D.graph_nodes(spark, d).select("id", "type", F.col("children").alias("contains"))
    return quality.container_integrity(docs.distinct())


SQL_ORPHANS = f"""with {D.SQL_NODES} select 'warning' as severity, 'orphan' as finding, id, '' as detail from own where type not in ('root', 'category') and id not in (select child from own where child is not null)
union all select 'warning', 'contains_not_found', id, child from own where child is not null and child not in (select id from own)"""


def dangling_refs(spark, d):
    """Line items whose order is left out."""
    o = table(spark, d, "orders").filter("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("id"))
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ref"), "l_linenumber")
    return graph.dangling(l, o)


SQL_DANGLING = "select l_orderkey as ref, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 10 <> 3)"


def integrity_duplicates(spark, d):
    return graph.duplicates(table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id")), "id")


SQL_DUPLICATES = "select l_orderkey || '-' || l_linenumber as id, count(*) as n from lineitem group by 1 having count(*) > 1"


def health(spark, d):
    parts = integrity_summary(spark, d).select(F.when(F.col("severity") == "error", "FAIL").otherwise("WARN").alias("status"))
    return quality.health(parts)


SQL_HEALTH = (
    f"with {_FINDINGS} select case max(case severity when 'error' then 2 else 1 end) when 2 then 'FAIL' when 1 then 'WARN' else "
    f"'PASS' end as status from f"
)


def _records(spark, d):
    """Metadata of each page: fields by its id, so that all shares of checks occur."""
    k = F.col("page_id")
    names = ("title", "author", "dsDescription", "subject", "datasetContact", "geographicCoverage", "timePeriodCovered", "keyword", "publication", "license", "dataSources", "productionDate")
    fields = F.array_compact(F.array(*(F.when(k % (i + 2) != 0, F.named_struct(F.lit("typeName"), F.lit(n), F.lit("typeClass"), F.when(k % 3 == 0, "controlledVocabulary").otherwise("primitive"))) for i, n in enumerate(names))))
    pid = F.when(k % 4 == 0, F.concat(F.lit("10.5/"), k)).when(k % 4 == 1, F.concat(F.lit("doi:10.5/"), k)).when(k % 4 == 2, F.concat(F.lit("hdl:"), k))
    meta = F.to_json(F.struct(pid.alias("datasetPersistentId"), F.struct(F.when(k % 5 > 0, k).alias("versionNumber"), F.struct(F.struct(fields.alias("fields")).alias("citation")).alias("metadataBlocks")).alias("datasetVersion")))
    return table(spark, d, "pages").select("page_id", meta.alias("metadata"))


def fair_scores(spark, d):
    s = quality.fair_scores(quality.fair_checks(_records(spark, d), "page_id"), "page_id")
    return s.select("page_id", *(F.round(c, 6).alias(c) for c in ("findable", "accessible", "interoperable", "reusable", "overall", "passed_of_15")), "status")


def _has(i: int) -> str:
    return f"(case when page_id % {i + 2} <> 0 then 1 else 0 end)"


_SEVEN = " + ".join(_has(i) for i in range(7))
SQL_FAIR = f"""with c as (select page_id,
  (case when page_id % 4 in (0, 2) then 4 when page_id % 4 = 1 then 2 else 4 end) / 4.0 * 100 as f1, ({_SEVEN}) / 7.0 * 100 as f2,
  ((case when page_id % 4 < 3 then 1 else 0 end) + 1) / 3.0 * 100 as a1,
  ((case when page_id % 3 = 0 and ({_SEVEN} + {" + ".join(_has(i) for i in range(7, 12))}) > 0 then 1 else 0 end) + 2) / 3.0 * 100 as i2, {_has(8)} / 2.0 * 100 as i3,
  ({_SEVEN} + {_has(7)}) / 8.0 * 100 as r1, ({_has(9)} + 2) / 3.0 * 100 as r11, ({_has(10)} + {_has(11)} + (case when page_id % 5 > 0 then 1 else 0 end)) / 4.0 * 100 as r12 from pages),
p as (select page_id, (f1 + f2 + 200) / 4 as findable, (a1 + 300) / 4 as accessible, (100 + i2 + i3) / 3 as interoperable, (r1 + r11 + r12 + 100) / 4 as reusable from c),
o as (select *, (findable + accessible + interoperable + reusable) / 4 as overall from p)
select page_id, round(findable::double, 6) as findable, round(accessible::double, 6) as accessible, round(interoperable::double, 6) as interoperable, round(reusable::double, 6) as reusable,
  round(overall::double, 6) as overall, round(overall::double / 100 * 15, 6) as passed_of_15, case when overall >= 75 then 'compliant' when overall >= 50 then 'partial' else 'non-compliant' end as status from o"""


def archived_filter(spark, d):
    """Live nodes of JSON items, typed and titled by the first field that is filled."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    item = F.to_json(F.struct(F.concat(F.lit("n"), F.floor(k / 2).cast("long")).alias("id"), F.when(k % 3 == 0, F.col("p_name")).alias("name"), F.lit("").alias("label"), F.when(k % 7 == 0, "Archived").when(k % 7 == 1, "active").alias("status"), (k % 11 == 0).alias("archived"), F.when(k % 2 == 0, F.col("p_type")).alias("type"), F.concat(F.lit(".\\docs\\"), k).alias("path")))
    raw = p.select(F.lit(0).alias("spec_no"), k.alias("pos"), F.lit("domain").alias("graph"), F.lit("f.json").alias("source_file"), F.lit("skill").alias("default_type"), item.alias("item"))
    return graph.node_rows(raw).select("node_id", "node_type", "title", "source_path")


SQL_ARCHIVED = r"""with l as (select *, 'n' || (p_partkey // 2) as id from part where p_partkey % 7 <> 0 and p_partkey % 11 <> 0)
select id as node_id, case when p_partkey % 2 = 0 then p_type else 'skill' end as node_type, case when p_partkey % 3 = 0 then p_name else id end as title, 'docs/' || p_partkey as source_path
from l qualify row_number() over (partition by id order by p_partkey) = 1"""


_F = (
    structural_edges, edges_by_rule, edge_dedupe, replace_edges, graph_expand, stub_unlinked, stub_supersede, doc_backlink, coverage,
    integrity, integrity_summary, orphans, dangling_refs, integrity_duplicates, health, fair_scores, archived_filter,
)
QUERIES = {f.__name__: f for f in _F}
SQL = dict(zip(
    QUERIES,
    (
        SQL_STRUCTURAL, SQL_BY_RULE, SQL_EDGE_DEDUPE, SQL_REPLACE, SQL_EXPAND, SQL_UNLINKED, SQL_SUPERSEDE, SQL_BACKLINK, SQL_COVERAGE,
        SQL_INTEGRITY, SQL_INTEGRITY_SUMMARY, SQL_ORPHANS, SQL_DANGLING, SQL_DUPLICATES, SQL_HEALTH, SQL_FAIR, SQL_ARCHIVED,
    ),
    strict=True,
))
