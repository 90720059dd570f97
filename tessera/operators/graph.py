"""Knowledge-graph nodes and edges, path rules, stubs, lineage and session trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import text as T

#: List fields that are edges, attributes that are kept, fields that hold a path.
EDGE_FIELDS = ("governed_by", "guided_by", "applies_to", "constrains", "related_to", "links", "contains")
ATTRIBUTES = ("risk_triggers", "allowlisted_mutations", "prod_live_verification", "decision_rule", "type", "category", "priority", "status", "tier")
PATH_FIELDS = ("path", "source_file", "file_path", "file", "content_path")
ARCHIVED = ("archived", "deprecated", "deleted")
#: Path prefixes whose documents belong to one node. A site adds its own by `rules`.
DOMAIN_RULES = (
    ("docs/architecture/", "cat-architecture", "path:architecture"),
    ("agents/skills/", "skills-root", "path:agents/skills"),
    ("agents/behaviors/", "behavior-root", "path:agents/behaviors"),
)
EXCLUDED_PREFIX = "docs/plan/"


def _filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def node_rows(raw: DataFrame) -> DataFrame:
    """Curated nodes from raw items (spec_no, pos, graph, source_file, default_type, and the item as JSON text).

    Archived items and those without an id are left out; of one id the first by (spec_no, pos) counts.
    """
    j = lambda p: F.get_json_object("item", f"$.{p}")
    path = T.normalise_path(_filled(*(j(p) for p in PATH_FIELDS)))
    archived = F.coalesce(j("archived") == "true", F.lit(False)) | F.coalesce(F.lower(j("status")).isin(*ARCHIVED), F.lit(False))
    rows = raw.withColumn("node_id", j("id")).filter(F.coalesce(F.col("node_id") != "", F.lit(False)) & ~archived)
    attrs = F.map_filter(F.create_map(*(x for a in ATTRIBUTES for x in (F.lit(a), j(a)))), lambda k, v: v.isNotNull())
    rows = rows.select(
        "spec_no", "pos", "node_id", "graph", "source_file",
        _filled(j("type"), j("data.type"), F.col("default_type")).alias("node_type"),
        _filled(j("name"), j("label"), j("data.label"), j("data.name"), j("id")).alias("title"),
        F.to_json(attrs).alias("attributes"), path.alias("source_path"), "item",
    )
    hashed = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c), F.lit("\x00")) for c in ("node_id", "node_type", "graph", "title", "attributes", "source_file", "source_path"))), 256)
    first = rows.withColumn("content_hash", hashed).groupBy("node_id").agg(F.min_by(F.struct("node_type", "graph", "title", "attributes", "source_file", "source_path", "content_hash"), F.struct("spec_no", "pos")).alias("n"))
    return first.select("node_id", "n.*")


def edge_rows(raw: DataFrame) -> DataFrame:
    """(src_id, dst_id, edge_type, graph): edges of the list fields of all items, also of ids that are repeated; each once."""

    def of(field: str) -> Column:
        targets = F.from_json(F.get_json_object("item", f"$.{field}"), "array<string>")
        return F.transform(F.coalesce(targets, F.array().cast("array<string>")), lambda t: F.struct(F.lit(field).alias("edge_type"), t.alias("dst_id")))

    each = F.concat(*(of(f) for f in EDGE_FIELDS))
    rows = raw.select(F.get_json_object("item", "$.id").alias("src_id"), "graph", F.explode(each).alias("e")).select("src_id", "e.dst_id", "e.edge_type", "graph")
    return dedupe_edges(rows.filter("src_id <> '' and dst_id <> ''"))


def listed_edges(raw: DataFrame) -> DataFrame:
    """Edges of a file's own list, in any of the three spellings of their ends; the type is `related` if none is given."""
    j = lambda p: F.get_json_object("item", f"$.{p}")
    rows = raw.select(_filled(j("from"), j("src_id"), j("source")).alias("src_id"), _filled(j("to"), j("dst_id"), j("target")).alias("dst_id"), F.coalesce(_filled(j("type"), j("edge_type")), F.lit("related")).alias("edge_type"), "graph")
    return dedupe_edges(rows.filter("src_id is not null and dst_id is not null"))


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One row for each (src_id, dst_id, edge_type), of the least graph."""
    return edges.groupBy("src_id", "dst_id", "edge_type").agg(F.min("graph").alias("graph"))


def replace_edges(old: DataFrame, new: DataFrame, structural: bool) -> DataFrame:
    """Replace the structural, or all other, edges; edges without a graph survive a curated load."""
    mine = F.col("graph") == "structural"
    if structural:
        keys = ["src_id", "dst_id", "edge_type"]
        rest, fresh = old.filter(~mine | F.col("graph").isNull()), new.withColumn("graph", F.lit("structural"))
        both = rest.withColumn("_new", F.lit(False)).unionByName(fresh.withColumn("_new", F.lit(True)))
        # One sort of both sides in a task. A key with a null equals no other, so old edges of such a key stay.
        w = W.partitionBy(*keys).orderBy(F.desc("_new"))
        whole = reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))
        both = both.withColumn("_first", F.row_number().over(w) == 1).withColumn("_replaced", F.first("_new").over(w) & whole)
        return both.filter(F.when(F.col("_new"), F.col("_first")).otherwise(~F.col("_replaced"))).select(*keys, "graph")
    return dedupe_edges(old.filter(mine | F.col("graph").isNull()).unionByName(new))


def structural_edges(docs: DataFrame, nodes: DataFrame, rules: tuple[tuple[str, str, str], ...] = DOMAIN_RULES) -> DataFrame:
    """Edges from documents' paths (node_id, source_path) to nodes that exist; the first rule that fits counts.

    (src_id, dst_id, edge_type, provenance)
    """
    # The path is a generated column, so that the rules' filters don't repeat how it is made.
    named = docs.select("node_id", F.explode(F.array(T.normalise_path(F.col("source_path")))).alias("path")).filter(F.col("path").isNotNull() & ~F.startswith("path", F.lit(EXCLUDED_PREFIX)))
    named = named.select("node_id", "path", F.split("path", "/").alias("parts")).withColumn("slug", F.get("parts", F.lit(3)))
    active = F.startswith("path", F.lit("docs/projects/active/")) & (F.size("parts") >= 4)
    index = F.struct(F.concat(F.lit("doc:domain:projects:active:"), "slug", F.lit(":index")).alias("target"), F.lit("belongs_to").alias("edge_type"), F.lit("path:projects/active").alias("provenance"))
    rule = F.when(active, F.when((F.col("slug") != "") & ~F.endswith("slug", F.lit(".md")), index))
    for prefix, target, provenance in rules:
        rule = rule.when(F.startswith("path", F.lit(prefix)), F.struct(F.lit(target).alias("target"), F.lit("in_domain").alias("edge_type"), F.lit(provenance).alias("provenance")))
    rows = named.select("node_id", rule.alias("r")).filter("r is not null").select("node_id", "r.*")
    found = rows.join(nodes.select(F.col("node_id").alias("target")).distinct(), "target")
    out = found.select(F.col("node_id").alias("src_id"), F.col("target").alias("dst_id"), "edge_type", "provenance")
    back = found.filter("edge_type = 'belongs_to'").select(F.col("target").alias("src_id"), F.col("node_id").alias("dst_id"), F.lit("contains").alias("edge_type"), "provenance")
    return out.unionByName(back).distinct()


def unlinked_docs(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Documents (doc_id, path) whose normalised path no curated node has, without excluded ones."""
    p = docs.withColumn("path", T.normalise_path(F.col("path"))).filter(F.col("path").isNotNull() & ~F.startswith("path", F.lit(EXCLUDED_PREFIX)))
    curated = nodes.filter("graph <> 'docshare-stub'").select(T.normalise_path(F.col("source_path")).alias("path")).filter("path is not null")
    return p.join(curated, "path", "left_anti")


def backlink(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Documents with the node at their path (of several, the greatest id) and `kg_indexed`."""
    at = nodes.select(T.normalise_path(F.col("source_path")).alias("path"), "node_id").filter("path is not null").groupBy("path").agg(F.max("node_id").alias("kg_node_id"))
    return docs.withColumn("path", T.normalise_path(F.col("path"))).join(at, "path", "left").withColumn("kg_indexed", F.col("kg_node_id").isNotNull())


def stub_nodes(unlinked: DataFrame) -> DataFrame:
    """Stub nodes for documents without a node: (node_id, node_type, graph, title, attributes, source_path, content_hash)."""
    attrs = F.to_json(F.struct(F.lit("stub").alias("tier"), F.col("doc_id").cast("string").alias("docshare_doc_id"), F.col("path").alias("source_path")))
    rows = unlinked.select(T.stub_id(F.col("doc_id").cast("string")).alias("node_id"), F.lit("document").alias("node_type"), F.lit("docshare-stub").alias("graph"), F.coalesce("title", "path").alias("title"), attrs.alias("attributes"), F.col("path").alias("source_path"))
    return rows.withColumn("content_hash", F.sha2(F.concat_ws("\x1f", "node_id", "title", "attributes"), 256))


def retract_stubs(nodes: DataFrame, now: Column, prefix: str = EXCLUDED_PREFIX) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, graph, source_path, superseded_at) with current stubs under a path prefix closed, and one row:
    `remaining`, the current stubs that are left there."""
    own = (F.col("graph") == "docshare-stub") & F.startswith(F.coalesce(T.normalise_path(F.col("source_path")), F.lit("")), F.lit(prefix))
    current = F.col("superseded_at").isNull()
    after = nodes.withColumn("superseded_at", F.when(own & current, now).otherwise(F.col("superseded_at")))
    return after, after.agg(F.count_if(own & current).alias("remaining"))


def stubs_to_supersede(nodes: DataFrame) -> DataFrame:
    """Stubs whose path a curated node owns now, in whatever order they were loaded."""
    stub = F.col("graph") == "docshare-stub"
    return nodes.filter(stub).join(nodes.filter(~stub).select("source_path"), "source_path", "left_semi")


def json_text(value: Column) -> Column:
    """A string as JSON; null is JSON's null."""
    one = F.to_json(F.array(value))
    return F.when(value.isNull(), "null").otherwise(F.substring(one, F.lit(2), F.length(one) - 2))


def with_json(attributes: Column, **values: Column) -> Column:
    """A JSON object's text with members (given as JSON text) added or put in place: its other members keep their types, numbers,
    objects and lists as they are, in order of their names, and the given ones come last. What is no object (null, or text that
    can't be read) becomes an object of these alone."""
    held = F.map_entries(F.try_variant_get(F.try_parse_json(attributes), "$", "map<string,variant>"))
    kept = F.transform(F.filter(held, lambda e: ~e["key"].isin(*values)), lambda e: F.concat(json_text(e["key"]), F.lit(":"), F.to_json(e["value"])))
    new = F.array(*(F.concat(json_text(F.lit(name)), F.lit(":"), value) for name, value in values.items()))
    return F.concat(F.lit("{"), F.array_join(F.concat(F.coalesce(kept, F.array().cast("array<string>")), new), ","), F.lit("}"))


def with_attribute(attributes: Column, name: str, value: Column) -> Column:
    """The same for one member with a string."""
    return with_json(attributes, **{name: json_text(value)})


def linked_metadata(docs: DataFrame, nodes: DataFrame, metadata: str = "metadata_json") -> DataFrame:
    """Documents (path and a JSON text) with `kg_node_id` and `kg_indexed` in that text: the node at their path, or null and false."""
    linked = backlink(docs, nodes)
    text = with_json(F.col(metadata), kg_node_id=json_text(F.col("kg_node_id")), kg_indexed=F.col("kg_indexed").cast("string"))
    return linked.withColumn(metadata, text)


def is_indexed(metadata: Column) -> Column:
    """Whether a document's metadata say that a node has it, whatever blanks the text holds."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(metadata), "$.kg_indexed", "boolean"), F.lit(False))


def backlink_nodes(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Nodes (node_id, source_path, attributes) whose attributes name the document at their path (of several, the greatest id); of nodes
    at one path the greatest id is linked. Nodes without a document, and those that name it already, stay as they are."""
    path = T.normalise_path(F.col("source_path"))
    ids = docs.select(T.normalise_path(F.col("path")).alias("_path"), F.trim(F.col("doc_id").cast("string")).alias("_doc")).filter("_path is not null and _doc <> ''")
    known = ids.groupBy("_path").agg(F.max("_doc").alias("_doc"))
    owner = nodes.select(path.alias("_path"), "node_id").filter("_path is not null").groupBy("_path").agg(F.max("node_id").alias("node_id"))
    joined = nodes.join(owner.join(known, "_path").select("node_id", "_doc"), "node_id", "left")
    other = F.col("_doc").isNotNull() & ~F.get_json_object("attributes", "$.docshare_doc_id").eqNullSafe(F.col("_doc"))
    return joined.withColumn("attributes", F.when(other, with_attribute(F.col("attributes"), "docshare_doc_id", F.col("_doc"))).otherwise(F.col("attributes"))).drop("_doc")


def repair_stub_docs(nodes: DataFrame) -> DataFrame:
    """Stubs whose attributes name another document than their id does get the id's; other nodes stay as they are."""
    own = F.regexp_replace("node_id", "^stub-", "")
    wrong = (F.col("graph") == "docshare-stub") & ~F.get_json_object("attributes", "$.docshare_doc_id").eqNullSafe(own)
    fixed = with_attribute(F.col("attributes"), "docshare_doc_id", own)
    return nodes.withColumn("attributes", F.when(wrong, fixed).otherwise(F.col("attributes")))


def coverage(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: total, linked and unlinked documents, and stubs."""
    n_stubs = nodes.agg(F.count_if(F.col("graph") == "docshare-stub").alias("stubs")).scalar()
    counts = docs.agg(F.count("*").alias("total"), F.count_if("kg_indexed").alias("linked"))
    return counts.select("total", "linked", F.greatest(F.lit(0), F.col("total") - F.col("linked")).alias("unlinked"), n_stubs.alias("stubs"))


def expand(start: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """(node_id, hop): nodes reached from the start nodes over at most `hops` edges, by the fewest."""
    seen = start.select("node_id").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        step = seen.filter(F.col("hop") == hop - 1).join(edges, F.col("node_id") == F.col("src_id")).select(F.col("dst_id").alias("node_id"), F.lit(hop).alias("hop"))
        seen = seen.unionByName(step).groupBy("node_id").agg(F.min("hop").alias("hop"))
    return seen


def dangling(refs: DataFrame, ids: DataFrame, ref: str = "ref", key: str = "id") -> DataFrame:
    """References to ids that don't exist."""
    return refs.join(ids.select(F.col(key).alias(ref)), ref, "left_anti")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def lineage(spark: SparkSession, sessions: str | DataFrame, start: int | str) -> DataFrame:
    """Of sessions (a table, or the name of a view, with session_id and parent_session_id): (session_id, parent_session_id, depth) from a session up its parents; a loop or a missing parent ends it.

    Each round doubles how far the walk has come, until nothing is added.
    """
    from tessera.operators.staging import staged

    rows = spark.table(sessions) if isinstance(sessions, str) else sessions
    jump = rows.select("session_id", F.col("parent_session_id").alias("up")).join(rows.select(F.col("session_id").alias("up")), "up", "left_semi")
    jump = staged(jump.select("session_id", "up").distinct(), "lineage")
    seen = rows.filter(F.col("session_id") == F.lit(start)).select("session_id", F.lit(0).alias("depth")).distinct()
    n, far = 1, 1
    while True:
        further = seen.join(jump, "session_id").select(F.col("up").alias("session_id"), (F.col("depth") + far).alias("depth"))
        seen = staged(seen.unionByName(further).groupBy("session_id").agg(F.min("depth").alias("depth")), "lineage")
        now = seen.count()
        if now <= n:
            return rows.join(seen, "session_id").select("session_id", "parent_session_id", "depth")
        n, far = now, 2 * far
        jump = staged(jump.join(jump.select(F.col("session_id").alias("up"), F.col("up").alias("_up")), "up").select("session_id", F.col("_up").alias("up")).distinct(), "lineage")


def ancestors(sessions: DataFrame, rounds: int = 40) -> DataFrame:
    """(session_id, root, depth) of every session, by pointer doubling: each round doubles how far a row sees,
    so a forest of depth d takes log2(d) joins whatever its size. Sessions on a loop get null."""
    from tessera.operators.staging import staged

    at = sessions.select("session_id", F.col("parent_session_id").alias("up"))
    ids = sessions.select(F.col("session_id").alias("up"), F.lit(True).alias("_there"))
    at = at.join(ids, "up", "left").select("session_id", F.when(F.col("_there"), F.col("up")).alias("up"))
    now = at.select("session_id", F.coalesce("up", "session_id").alias("root"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("up").isNull().alias("done"))
    now = staged(now, "ancestors")
    for _ in range(rounds):
        if not now.filter("not done").limit(1).count():
            return now.drop("done")
        far = now.select(F.col("session_id").alias("root"), F.col("root").alias("_r"), F.col("depth").alias("_d"), F.col("done").alias("_done"))
        now = staged(now.join(far, "root").select("session_id", F.when(F.col("done"), F.col("root")).otherwise(F.col("_r")).alias("root"), F.when(F.col("done"), F.col("depth")).otherwise(F.col("depth") + F.col("_d")).alias("depth"), (F.col("done") | F.col("_done")).alias("done")), "ancestors")
    return now.select("session_id", F.when(F.col("done"), F.col("root")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"))


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
