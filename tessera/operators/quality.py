"""Graph integrity, schema rules, leak scanning, metadata (FAIR) scores and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T

BLOCK, WARN = "block", "warn"
#: Leak rules (id, severity, pattern) and, where it is known, strings of which a match holds
#: one in lower case. A site adds the names of its own hosts, people, folders and stores.
LEAK_RULES = (
    ("private-ip-10", BLOCK, r"\b10\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", ("10.",)),
    ("private-ip-192", BLOCK, r"\b192\.168\.\d{1,3}\.\d{1,3}\b", ("192.168.",)),
    ("private-ip-172", BLOCK, r"\b172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}\b", ("172.",)),
    ("email", BLOCK, r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", ("@",)),
    ("win-drive-path", BLOCK, r"[A-Za-z]:\\\\?(?:projects|Users)", (":\\",)),
    ("repo-abs-path", WARN, r"[Cc]:[\\/]projects[\\/]", ("projects",)),
    ("assigned-secret", BLOCK, r"(?i)\b(secret|password|passwd|access[_-]?key|api[_-]?key|token)\b\s*[:=]\s*['\"][^'\"]{6,}['\"]", ("secret", "passw", "key", "token")),
    ("openai-key", BLOCK, r"\bsk-[A-Za-z0-9]{20,}\b", ("sk-",)),
    ("aws-key", BLOCK, r"\bAKIA[0-9A-Z]{16}\b", ("akia",)),
)


def leak_scan(texts: DataFrame, key: str, text: str, rules=LEAK_RULES, allow: tuple[str, ...] = (), disable: tuple[str, ...] = (), add: tuple = ()) -> DataFrame:
    """(key, line, rule_id, severity, excerpt, allowlisted): a row a rule that a line breaks.

    The rules are literals of one projection, so lines meet them without a join. A pattern runs only on
    lines that hold one of its rule's strings; texts that hold none of any rule's aren't split at all."""
    rules = [(*r, ())[:4] for r in (*(r for r in rules if r[0] not in disable), *add)]
    if all(marks for *_, marks in rules):
        texts = texts.filter(T.holds_any(F.lower(text), tuple(dict.fromkeys(m for *_, marks in rules for m in marks))))
    lines = texts.select(key, F.posexplode(F.split(F.col(text), r"\r\n|\n|\r")).alias("at", "content"))

    def breaks(pattern: str, marks: tuple[str, ...]) -> Column:
        hit = F.rlike("content", F.lit(pattern))
        return F.when(T.holds_any(F.lower("content"), marks), hit).otherwise(False) if marks else hit

    broken = F.array_compact(F.array(*(F.when(breaks(p, marks), F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"))) for i, s, p, marks in rules)))
    allowed = F.lit(False)
    for a in allow:
        allowed = allowed | F.contains("content", F.lit(a))
    found = lines.withColumn("r", F.explode(broken))
    return found.select(key, (F.col("at") + 1).alias("line"), "r.rule_id", "r.severity", F.substring(F.trim("content"), 1, 200).alias("excerpt"), allowed.alias("allowlisted"))


def leak_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.count_if("allowlisted").alias("n_allowlisted"))


def gate(findings: DataFrame) -> DataFrame:
    """One row: FAIL if a blocking finding isn't on the allow-list."""
    bad = F.count_if((F.col("severity") == BLOCK) & ~F.col("allowlisted"))
    return findings.agg(F.when(bad > 0, "FAIL").otherwise("PASS").alias("status"), bad.alias("n_blocking"))


def health(checks: DataFrame) -> DataFrame:
    """One status of all checks: the worst of PASS, WARN and FAIL."""
    worst = F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0))
    return checks.agg(F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), worst + 1).alias("status"))


def integrity(nodes: DataFrame, metadata_total: int | None = None) -> DataFrame:
    """(severity, finding, id, detail) of nodes (id, type, parent, children): duplicates, missing fields, references to
    nothing, orphans (roots are none), and a count that the metadata claims wrongly."""
    ids = nodes.select("id").distinct()
    row = lambda df, sev, what, key, detail: df.select(F.lit(sev).alias("severity"), F.lit(what).alias("finding"), key.cast("string").alias("id"), detail.cast("string").alias("detail"))
    dup = nodes.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    missing = nodes.filter("id is null or type is null")
    parent = nodes.filter("parent is not null and parent <> ''").join(ids.select(F.col("id").alias("parent")), "parent", "left_anti")
    child = nodes.select("id", F.explode("children").alias("child")).join(ids.select(F.col("id").alias("child")), "child", "left_anti")
    orphan = nodes.filter("coalesce(type, '') <> 'root' and not coalesce(contains(id, 'root'), false) and coalesce(parent, '') = ''")
    out = row(dup, "error", "duplicate", F.col("id"), F.col("n"))
    out = out.unionByName(row(missing, "error", "missing_field", F.col("id"), F.when(F.col("id").isNull(), "id").otherwise("type")))
    out = out.unionByName(row(parent, "error", "parent_not_found", F.col("id"), F.col("parent")))
    out = out.unionByName(row(child, "error", "child_not_found", F.col("id"), F.col("child")))
    out = out.unionByName(row(orphan, "error", "orphan", F.col("id"), F.lit("")))
    if metadata_total is not None:
        wrong = nodes.agg(F.count("*").alias("n")).filter(F.col("n") != metadata_total)
        out = out.unionByName(row(wrong, "warning", "metadata_count", F.lit(None), F.col("n")))
    return out


def container_integrity(docs: DataFrame) -> DataFrame:
    """The same for documents (id, type, contains) of the older format, as warnings; roots and categories are no orphans."""
    refs = docs.select("id", F.explode("contains").alias("child"))
    gone = refs.join(docs.select(F.col("id").alias("child")), "child", "left_anti").select(F.lit("warning").alias("severity"), F.lit("contains_not_found").alias("finding"), "id", F.col("child").alias("detail"))
    lone = docs.filter("coalesce(type, '') not in ('root', 'category')").join(refs.select(F.col("child").alias("id")), "id", "left_anti")
    return gone.unionByName(lone.select(F.lit("warning").alias("severity"), F.lit("orphan").alias("finding"), "id", F.lit("").alias("detail")))


#: What a graph file of each kind must have: its fields, its graphType, and its list of items.
SCHEMAS = {
    "skills": (("graphType", "role", "generatedAt", "skills"), "skills", "skills"),
    "behaviors": (("graphType", "role", "generatedAt", "behaviors"), "behaviors", "behaviors"),
    "knowledge": (("graphType", "role", "generatedAt"), "knowledge", None),
    "master": (("graphType", "project", "version", "generatedAt", "roles"), "master", None),
}
PRIORITIES = ("low", "medium", "high", "critical")
GRAPH_FOLDER = "agents/knowledge-graphs/"
_ITEMS = "array<struct<id:string,type:string,name:string,priority:string>>"
_ROLES = "array<struct<id:string,name:string,graphs:array<struct<id:string,path:string>>>>"


def schema_findings(files: DataFrame, kind: str) -> DataFrame:
    """(path, finding) for JSON files (path, value) that break the rules of their kind; no rows: valid.

    A kind of finding comes once a file. A file that isn't there is one with a null value.
    """
    required, const, listed = SCHEMAS[kind]
    j = lambda p: F.get_json_object("value", f"$.{p}")
    rows = lambda text, kind_: F.coalesce(F.from_json(text, kind_), F.array().cast(kind_))
    any_ = lambda array, test: F.exists(array, lambda x: F.coalesce(test(x), F.lit(False)))
    readable = F.try_parse_json("value").isNotNull()
    tests = [F.when(F.col("value").isNull(), "missing file").when(~readable, "not JSON")]
    broken = [(j(f).isNull(), f"missing {f}") for f in required] + [(j("graphType") != const, "wrong graphType")]
    if kind == "master":
        roles = rows(j("roles"), _ROLES)
        entries = F.flatten(F.transform(roles, lambda r: F.coalesce(r["graphs"], F.array().cast("array<struct<id:string,path:string>>"))))
        broken += [
            (any_(roles, lambda r: r["id"].isNull() | r["name"].isNull() | r["graphs"].isNull()), "role without id, name or graphs"),
            (any_(roles, lambda r: ~F.startswith(r["id"], F.lit("role-"))), "wrong role id"),
            (any_(entries, lambda g: g["id"].isNull() | g["path"].isNull()), "graph without id or path"),
            (any_(entries, lambda g: ~F.startswith(g["path"], F.lit(GRAPH_FOLDER))), "graph outside its folder"),
        ]
    else:
        broken.append((~F.startswith(j("role"), F.lit("role-")), "wrong role"))
        text = j(listed) if listed else F.coalesce(j("nodes"), j("documents"))
        items = rows(text, _ITEMS)
        least = (lambda x: x["id"].isNull() | (x["id"] == "")) if listed else (lambda x: x["id"].isNull())
        broken += [(any_(items, least), "item without id"), (any_(items, lambda x: x["type"] == ""), "empty type")]
        if kind == "skills":
            broken.append((any_(items, lambda x: x["name"] == ""), "empty name"))
        if kind == "behaviors":
            broken.append((any_(items, lambda x: ~x["priority"].isin(*PRIORITIES)), "unknown priority"))
        if kind == "knowledge":
            broken.append((j("nodes").isNull() == j("documents").isNull(), "not exactly one of nodes and documents"))
    tests += [F.when(readable & test, finding) for test, finding in broken]
    return files.select("path", F.explode(F.array_compact(F.array(*tests))).alias("finding"))


#: The citation fields that descriptions need.
_DESCRIBED = ("title", "author", "dsDescription", "subject", "datasetContact", "geographicCoverage", "timePeriodCovered")
_FIELDS = "array<struct<typeName:string,typeClass:string>>"


def _filled(c: Column) -> Column:
    return F.coalesce(~c.isin("", "[]", "{}", "null", "false", "0"), F.lit(False))


def fair_checks(records: DataFrame, key: str, metadata: str = "metadata") -> DataFrame:
    """(key, principle, sub, passed, total): the checks of each sub-principle of one JSON record."""
    j = lambda p: F.get_json_object(metadata, p)
    pid = j("$.datasetPersistentId")
    has_pid = _filled(pid)
    citation = _filled(j("$.datasetVersion.metadataBlocks.citation"))
    blocks = _filled(j("$.datasetVersion.metadataBlocks"))
    fields = F.coalesce(F.from_json(j("$.datasetVersion.metadataBlocks.citation.fields"), _FIELDS), F.array().cast(_FIELDS))
    has = lambda name: F.exists(fields, lambda f: f["typeName"] == name)
    shaped = F.when(has_pid, F.startswith(pid, F.lit("10.")) | F.startswith(pid, F.lit("hdl:"))).otherwise(citation)
    true = F.lit(True)
    subs = {
        ("F", "F1"): [F.when(has_pid, true).otherwise(citation), shaped, shaped, true],
        ("F", "F2"): [has(n) for n in _DESCRIBED],
        ("F", "F3"): [true] * 3,
        ("F", "F4"): [true] * 3,
        ("A", "A1"): [has_pid, true, _filled(j("$.datasetVersion.files"))],
        ("A", "A1.1"): [true] * 3,
        ("A", "A1.2"): [true] * 2,
        ("A", "A2"): [true] * 3,
        ("I", "I1"): [true] * 4,
        ("I", "I2"): [F.exists(fields, lambda f: f["typeClass"] == "controlledVocabulary"), true, true],
        ("I", "I3"): [has("publication"), has("relatedDatasets")],
        ("R", "R1"): [has(n) for n in (*_DESCRIBED, "keyword")],
        ("R", "R1.1"): [has("license"), true, true],
        ("R", "R1.2"): [has("dataSources"), has("productionDate"), has("contributor"), _filled(j("$.datasetVersion.versionNumber"))],
        ("R", "R1.3"): [true, blocks, citation],
    }
    each = [F.struct(F.lit(p).alias("principle"), F.lit(s).alias("sub"), sum((c.cast("int") for c in checks), F.lit(0)).alias("passed"), F.lit(len(checks)).alias("total")) for (p, s), checks in subs.items()]
    return records.select(key, F.explode(F.array(*each)).alias("c")).select(key, "c.*")


def fair_scores(checks: DataFrame, key: str) -> DataFrame:
    """(key, findable, accessible, interoperable, reusable, overall, passed_of_15, status): a principle is the mean of its
    sub-principles, the score the mean of the four."""
    share = F.col("passed") / F.col("total") * 100.0
    by = checks.groupBy(key).agg(*(F.avg(F.when(F.col("principle") == p, share)).alias(n) for p, n in (("F", "findable"), ("A", "accessible"), ("I", "interoperable"), ("R", "reusable"))))
    overall = (F.col("findable") + F.col("accessible") + F.col("interoperable") + F.col("reusable")) / 4.0
    status = F.when(F.col("overall") >= 75, "compliant").when(F.col("overall") >= 50, "partial").otherwise("non-compliant")
    return by.withColumn("overall", overall).withColumn("passed_of_15", F.col("overall") / 100.0 * 15.0).withColumn("status", status)


def rules_frame(spark: SparkSession, rules=LEAK_RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_id string, severity string, pattern string")
