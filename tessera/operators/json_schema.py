"""A compiler from JSON Schema (the part of Draft 7 that graph files use) to column expressions over VARIANT.

A schema becomes one expression of a document: an array of findings, each with the JSON path of the value, the rule it breaks and
what was wanted. Spark evaluates it row by row without Python; references are resolved while compiling.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import once

FINDING = "array<struct<path: string, rule: string, detail: string>>"
#: Keywords that say nothing about validity.
ANNOTATIONS = {"$schema", "$id", "title", "description", "definitions", "format", "default", "examples", "$comment"}
KEYWORDS = {"type", "required", "const", "enum", "pattern", "minLength", "items", "properties", "additionalProperties", "oneOf", "$ref"}
_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _is(v: Column, kind: str) -> Column:
    """Whether a value is of a JSON type. Only of scalars is the type's name worked out, as that of others lists all that they hold."""
    object_, array = _as(v, "map<string,variant>").isNotNull(), _as(v, "array<variant>").isNotNull()
    if kind == "object":
        return object_
    if kind == "array":
        return array
    name = F.when(~object_ & ~array, F.schema_of_variant(v))
    if kind == "null":
        return F.coalesce(name == "VOID", F.lit(False))
    if kind in ("string", "boolean"):
        return F.coalesce(name == kind.upper(), F.lit(False))
    number = name.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(name, F.lit("DECIMAL"))
    if kind == "integer":  # 1.0 is one
        return F.coalesce(number & (_as(v, "double") == F.floor(_as(v, "double"))), F.lit(False))
    if kind == "number":
        return F.coalesce(number, F.lit(False))
    raise ValueError(f"unknown type {kind}")


def _same(v: Column, values: list) -> Column:
    """Whether a value is one of some."""
    texts = [json.dumps(x) for x in values]
    # What is written the same way by everyone is compared as text; the rest as Spark writes it.
    plain = [t for t, x in zip(texts, values, strict=True) if x is None or isinstance(x, (bool, int)) and abs(x) < 1 << 63 or isinstance(x, str) and re.fullmatch(r"[ !#-\[\]-~]*", x)]
    others = [F.to_json(F.parse_json(F.lit(t))) for t in texts if t not in plain]
    return F.coalesce(F.to_json(v).isin(*map(F.lit, plain), *others), F.lit(False)) if texts else F.lit(False)


def _none() -> Column:
    return F.array().cast(FINDING)


def _found(when: Column, path: Column, rule: str, detail: str) -> Column:
    one = F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule"), F.lit(detail).alias("detail")))
    return F.when(when, one).otherwise(_none())


def _member(members: Column, name: str) -> Column:
    """A member of an object; null if it has none of that name (a member that is JSON null is there)."""
    return F.element_at(members, name)


def _below(path: Column, name: Column) -> Column:
    return F.when(path == "(root)", name).otherwise(F.concat(path, F.lit("/"), name))


def compile_schema(schema: dict) -> Callable[[Column], Column]:
    """A function from a VARIANT column to its findings (path, rule, detail); an empty array for a valid document, null for a null one.

    Unknown keywords, references that aren't local and schemas that hold themselves are refused.
    """
    build = _compiled(schema, schema, ())
    return lambda v: once(v, lambda x: F.when(x.isNotNull(), build(x, F.lit("(root)"))))


def _compiled(schema: dict | bool, root: dict, within: tuple[str, ...]) -> Callable[[Column, Column], Column]:
    if schema is True:
        return lambda v, path: _none()
    if schema is False:
        return lambda v, path: _found(F.lit(True), path, "false", "")
    if "$ref" in schema:  # what stands beside a reference doesn't count
        ref = schema["$ref"]
        if ref in within or not ref.startswith("#/"):
            raise ValueError(f"reference {ref}")
        target: object = root
        for step in ref[2:].split("/"):
            target = target[step.replace("~1", "/").replace("~0", "~")]
        return _compiled(target, root, (*within, ref))
    unknown = set(schema) - ANNOTATIONS - KEYWORDS
    if unknown:
        raise ValueError(f"keywords {sorted(unknown)}")
    rules: list[Callable[[Column, Column, Column], Column]] = []  # of the value, its members (null if it is no object) and its path

    def rule(test: Callable[[Column], Column], name: str, detail: object) -> None:
        text = detail if isinstance(detail, str) else json.dumps(detail)
        rules.append(lambda v, members, path: _found(test(v), path, name, text))

    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]

        def wrong(v: Column) -> Column:
            right = _is(v, kinds[0])
            for k in kinds[1:]:
                right = right | _is(v, k)
            return ~right

        rule(wrong, "type", ",".join(kinds))
    if "const" in schema:
        rule(lambda v: ~_same(v, [schema["const"]]), "const", schema["const"])
    if "enum" in schema:
        rule(lambda v: ~_same(v, schema["enum"]), "enum", schema["enum"])
    if "pattern" in schema:
        rule(lambda v: _is(v, "string") & ~F.rlike(_as(v, "string"), F.lit(schema["pattern"])), "pattern", schema["pattern"])
    if "minLength" in schema:
        rule(lambda v: _is(v, "string") & (F.length(_as(v, "string")) < schema["minLength"]), "minLength", schema["minLength"])
    for name in schema.get("required", []):
        rules.append(lambda v, members, path, name=name: _found(members.isNotNull() & _member(members, name).isNull(), path, "required", name))
    known = schema.get("properties", {})
    for name, sub in known.items():
        own = _compiled(sub, root, within)
        rules.append(lambda v, members, path, name=name, own=own: once(_member(members, name), lambda m: F.when(m.isNotNull(), own(m, _below(path, F.lit(name)))).otherwise(_none())))
    if schema.get("additionalProperties", True) is not True:
        more = _compiled(schema["additionalProperties"], root, within)

        def rest(v: Column, members: Column, path: Column) -> Column:
            others = F.map_entries(members)
            others = F.filter(others, lambda e: ~e["key"].isin(*known)) if known else others
            return F.coalesce(F.flatten(F.transform(others, lambda e: more(e["value"], _below(path, e["key"])))), _none())

        rules.append(rest)
    if "items" in schema:
        each = _compiled(schema["items"], root, within)

        def items(v: Column, members: Column, path: Column) -> Column:
            return F.coalesce(F.flatten(F.transform(_as(v, "array<variant>"), lambda x, i: each(x, _below(path, i.cast("string"))))), _none())

        rules.append(items)
    if "oneOf" in schema:
        ways = [_compiled(sub, root, within) for sub in schema["oneOf"]]

        def one(v: Column, members: Column, path: Column) -> Column:
            fits = sum((F.when(F.size(way(v, path)) == 0, 1).otherwise(0) for way in ways), F.lit(0))
            return _found(fits != 1, path, "oneOf", str(len(ways)))

        rules.append(one)
    if not rules:
        return lambda v, path: _none()
    if not schema.keys() & {"required", "properties", "additionalProperties"}:
        return lambda v, path: F.concat(*(r(v, None, path) for r in rules))
    return lambda v, path: once(_as(v, "map<string,variant>"), lambda members: F.concat(*(r(v, members, path) for r in rules)))


def findings(files: DataFrame, schema: dict, key: str = "path", value: str = "value") -> DataFrame:
    """(key, at, rule, detail) of JSON files (key, value): no rows for a valid one. A file that isn't there has a null value and the
    finding `missing`, one that can't be read `parse`."""
    build = compile_schema(schema)

    def each(text: Column, doc: Column) -> Column:
        odd = F.when(text.isNull(), "missing").when(doc.isNull(), "parse")
        return F.when(odd.isNotNull(), F.array(F.struct(F.lit("(root)").alias("path"), odd.alias("rule"), F.lit("").alias("detail")))).otherwise(build(doc))

    found = once(F.col(value), lambda text: once(F.try_parse_json(text), lambda doc: each(text, doc)))
    # An inner explode would have all findings worked out again, to filter by their number.
    return files.select(F.col(key), F.explode_outer(found).alias("f")).filter("f is not null").select(key, F.col("f.path").alias("at"), "f.rule", "f.detail")


_TEXT, _FILLED, _TEXTS = {"type": "string"}, {"type": "string", "minLength": 1}, {"type": "array", "items": {"type": "string"}}
_MAYBE, _LINKS = {"type": ["string", "null"]}, {"type": "object", "additionalProperties": _TEXTS}


def _starting(*prefixes: str) -> dict:
    return {"type": "string", "pattern": f"^({'|'.join(prefixes)})" if len(prefixes) > 1 else f"^{prefixes[0]}"}


def _graph(kind: str, required: tuple[str, ...], properties: dict, **more) -> dict:
    return {"type": "object", "required": ["graphType", *required], "properties": {"graphType": {"type": "string", "const": kind}, "generatedAt": _TEXT, **properties}, **more}


def _listed(name: str) -> dict:
    return {"type": "array", "items": {"$ref": f"#/definitions/{name}"}}


#: The formats of the graph files, a schema a kind.
SCHEMAS: dict[str, dict] = {
    "skills": _graph(
        "skills", ("role", "generatedAt", "skills"), {"role": _starting("role-"), "skills": _listed("skill")},
        definitions={"skill": {"type": "object", "required": ["id"], "properties": {
            "id": _FILLED, "type": _FILLED, "name": _FILLED, "category": _TEXT, "description": _TEXT, "path": _MAYBE, "parent": _MAYBE, "created": _TEXT, "links": _LINKS}}},
    ),
    "behaviors": _graph(
        "behaviors", ("role", "generatedAt", "behaviors"), {"role": _starting("role-"), "behaviors": _listed("behavior")},
        definitions={"behavior": {"type": "object", "required": ["id"], "properties": {
            "id": _FILLED, "type": _FILLED, "name": _TEXT, "description": _TEXT, "path": _TEXT, "parent": _MAYBE, "links": _LINKS,
            "priority": {"type": "string", "enum": ["low", "medium", "high", "critical"]}}}},
    ),
    "knowledge": _graph(
        "knowledge", ("role", "generatedAt"), {"role": _starting("role-"), "nodes": _listed("node"), "documents": _listed("node")},
        oneOf=[{"required": ["nodes"]}, {"required": ["documents"]}],
        definitions={"node": {"type": "object", "required": ["id"], "properties": {"id": _TEXT, "type": _FILLED, "title": _TEXT, "path": _TEXT, "parent": _MAYBE, "links": _LINKS}}},
    ),
    "master": _graph(
        "master", ("project", "version", "generatedAt", "roles"),
        {"project": _TEXT, "version": _TEXT, "roles": _listed("role"), "cross_role_connections": {"type": "array", "items": {"type": "object"}}},
        definitions={
            "role": {"type": "object", "required": ["id", "name", "graphs"], "properties": {
                "id": _starting("role-"), "name": _TEXT, "description": _TEXT, "personality": _TEXT, "graphs": _listed("entry"),
                **dict.fromkeys(("responsibilities", "boundaries", "primary_skills", "primary_behaviors"), _TEXTS)}},
            "entry": {"type": "object", "required": ["id", "path"], "properties": {"id": _TEXT, "path": _starting("agents/knowledge-graphs/"), "description": _TEXT}},
        },
    ),
    "project": _graph(
        "project-graph", ("generatedAt", "nodes"),
        {"description": _TEXT, "links": {"type": "array", "items": {"type": "object"}}, "nodes": {"type": "array", "items": {"oneOf": [{"$ref": "#/definitions/project"}, {"$ref": "#/definitions/document"}]}}},
        definitions={
            "project": {"type": "object", "required": ["id", "type", "category", "path", "title", "status"], "properties": {
                "id": _starting("work:", "personal:", "public:", "private:"), "type": {"type": "string", "const": "project"}, "path": _TEXT, "title": _FILLED, "description": _TEXT,
                "category": {"type": "string", "enum": ["work", "personal", "public", "private"]}, "status": {"type": "string", "enum": ["active", "archived", "planned"]}}},
            "document": {"type": "object", "required": ["id", "type", "path", "title", "parent"], "properties": {
                "id": _starting("doc:"), "type": {"type": "string", "const": "document"}, "path": _TEXT, "title": _FILLED, "parent": _TEXT}},
        },
    ),
}

#: The files that are checked, and their kinds.
TARGETS = {
    "builder-skills": ("builder-skills-graph.json", "skills"),
    "builder-knowledge": ("builder-knowledge-graph.json", "knowledge"),
    "builder-behaviors": ("builder-behaviors-graph.json", "behaviors"),
    "domain-skills": ("domain-skills-graph.json", "skills"),
    "domain-behaviors": ("domain-behaviors.json", "behaviors"),
    "domain-docs": ("domain-docs-graph.json", "knowledge"),
    "master": ("master-graph.json", "master"),
}


def validate_targets(files: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(target, at, rule, detail) of the graph files (path, value) under their folder; a file that isn't among them is `missing`.

    A file is told by the last part of its path."""
    spark = files.sparkSession
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "value")
    wanted = {t: f for t, f in TARGETS.items() if not only or t in only}
    out = None
    for kind in sorted({k for _, k in wanted.values()}):
        own = spark.createDataFrame([(t, f) for t, (f, k) in wanted.items() if k == kind], "target string, file string")
        part = findings(own.join(named, "file", "left"), SCHEMAS[kind], key="target")
        out = part if out is None else out.unionByName(part)
    return out


def validation_summary(found: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(target, passed, n_findings) of every target that was asked for."""
    wanted = [t for t in TARGETS if not only or t in only]
    counts = found.groupBy("target").agg(F.count("*").alias("n_findings"))
    rows = found.sparkSession.createDataFrame([(t,) for t in wanted], "target string").join(counts, "target", "left")
    return rows.select("target", F.col("n_findings").isNull().alias("passed"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))
