"""Knowledge-graph files and Markdown bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Fixed values: (file, array, graph, type of items without one, prefix of chunk ids), in order of precedence.
GRAPH_FILES = (
    ("domain-behaviors.json", "behaviors", "domain", "behavior", "kg:behavior:"),
    ("domain-skills-graph.json", "skills", "domain", "skill", "kg:skill:"),
    ("domain-docs-graph.json", "documents", "domain", "document", "kg:doc:"),
    ("builder-knowledge-graph.json", "nodes", "builder", "concept", "kg:builder:"),
    ("builder-skills-graph.json", "skills", "builder", "skill", "kg:skill:builder:"),
    ("builder-behaviors-graph.json", "behaviors", "builder", "behavior", "kg:behavior:builder:"),
)


def graph_items(spark: SparkSession, folder: str, key: str | None = None) -> DataFrame:
    """(spec_no, pos, graph, source_file, default_type, prefix, item): the items of all graph files in a folder
    (or their own `edges`), each as JSON text. Missing files and arrays give no rows."""
    specs = spark.createDataFrame([(i, *s) for i, s in enumerate(GRAPH_FILES)], "spec_no int, source_file string, array string, graph string, default_type string, prefix string")
    whole = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source_file"), "value")
    rows = whole.join(F.broadcast(specs), "source_file")
    path = F.concat(F.lit("$."), F.lit(key) if key else F.col("array"))
    each = rows.withColumn("p", path).withColumn("items", F.coalesce(*(F.when(F.col("p") == f"$.{a}", F.expr(f"try_variant_get(try_parse_json(value), '$.{a}', 'array<variant>')")) for a in ("behaviors", "skills", "documents", "nodes", "edges"))))
    return each.select("spec_no", "graph", "source_file", "default_type", "prefix", F.posexplode("items").alias("pos", "v")).select("spec_no", "pos", "graph", "source_file", "default_type", "prefix", F.to_json("v").alias("item"))


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, body) of all Markdown files under a folder: front matter stripped, long bodies cut."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), T.markdown_body(F.col("value")).alias("body"))


def content_of(title, body, item):
    """Title and Markdown body if that has 30 characters, else the item itself; and which of them it is."""
    long = F.coalesce(F.length(body) >= 30, F.lit(False))
    return F.struct(F.when(long, F.concat(title, F.lit("\n\n"), body)).otherwise(F.concat(title, F.lit("\n\n"), item)).alias("content"), F.when(long, "markdown").otherwise("json").alias("content_source"))


def contains_text(json):
    """A `contains` list (JSON text) as lines: strings as they are, objects as `name: value` (the description where there is no
    value, or what there is of both); members without either go. Null and what is no list give an empty text."""
    items = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")

    def line(x):
        text = lambda p: F.nullif(F.try_variant_get(x, p, "string"), F.lit(""))
        name, value = text("$.name"), F.coalesce(text("$.value"), text("$.description"))
        of_object = F.coalesce(F.concat(name, F.lit(": "), value), value, name)
        return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.when(F.try_variant_get(x, "$", "map<string,variant>").isNotNull(), of_object))

    return F.coalesce(F.array_join(F.transform(items, line), "\n"), F.lit(""))


def _bare(path):
    """A local path in one spelling: `file:/a` and `file:///a` are `/a`."""
    return F.regexp_replace(path, r"^file:/+", "/")


def chunks(items: DataFrame, bodies: DataFrame, root: str = "") -> DataFrame:
    """(id, node_id, node_type, topic, content, content_source, content_sha256): a chunk a live item; of a repeated id the last."""
    j = lambda p: F.get_json_object("item", f"$.{p}")
    from tessera.operators.graph import ARCHIVED, PATH_FIELDS

    path = T.normalise_path(F.coalesce(*(F.nullif(j(p), F.lit("")) for p in PATH_FIELDS)))
    live = ~(F.coalesce(j("archived") == "true", F.lit(False)) | F.coalesce(F.lower(j("status")).isin(*ARCHIVED), F.lit(False)))
    rows = items.withColumn("node_id", j("id")).filter(F.coalesce(F.col("node_id") != "", F.lit(False)) & live & ~((F.col("prefix") == "kg:doc:") & F.endswith("node_id", F.lit("-root"))))
    named = bodies.select(_bare(F.col("path")).alias("_path"), "body")
    joined = rows.withColumn("_path", _bare(F.concat(F.lit(root), path))).join(named, "_path", "left")
    title = F.coalesce(F.nullif(j("name"), F.lit("")), F.nullif(j("label"), F.lit("")), F.nullif(j("data.label"), F.lit("")), F.col("node_id"))
    built = joined.select(F.concat("prefix", "node_id").alias("id"), "spec_no", "pos", "node_id", F.coalesce(F.nullif(j("type"), F.lit("")), F.col("default_type")).alias("node_type"), title.alias("topic"), content_of(title, F.col("body"), F.col("item")).alias("c"))
    built = built.select("id", "spec_no", "pos", "node_id", "node_type", "topic", "c.*").filter(F.length("content") >= 30)
    last = built.groupBy("id").agg(F.max_by(F.struct("node_id", "node_type", "topic", "content", "content_source"), F.struct("spec_no", "pos")).alias("r")).select("id", "r.*")
    return last.withColumn("content_sha256", F.sha2("content", 256))
