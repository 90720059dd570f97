"""The schema compiler against a plain interpreter, and the graph files' formats."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import json_schema as J


def kind_of(v):
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, int | float) else {str: "string", list: "array", dict: "object"}[type(v)]


def is_kind(v, kind):
    return kind_of(v) == "number" and float(v).is_integer() if kind == "integer" else kind_of(v) == kind


def same(a, b):
    return kind_of(a) == kind_of(b) and a == b


def plain(v, schema, root, path="(root)"):
    """Findings (path, rule, detail) of a value."""
    if isinstance(schema, bool):
        return [] if schema else [(path, "false", "")]
    if "$ref" in schema:
        target = root
        for step in schema["$ref"][2:].split("/"):
            target = target[step]
        return plain(v, target, root, path)
    out, text = [], lambda d: d if isinstance(d, str) else json.dumps(d)
    below = lambda name: name if path == "(root)" else f"{path}/{name}"
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        if not any(is_kind(v, k) for k in kinds):
            out.append((path, "type", ",".join(kinds)))
    if "const" in schema and not same(v, schema["const"]):
        out.append((path, "const", text(schema["const"])))
    if "enum" in schema and not any(same(v, e) for e in schema["enum"]):
        out.append((path, "enum", text(schema["enum"])))
    if isinstance(v, str):
        if "pattern" in schema and not re.search(schema["pattern"], v):
            out.append((path, "pattern", schema["pattern"]))
        if len(v) < schema.get("minLength", 0):
            out.append((path, "minLength", text(schema["minLength"])))
    if isinstance(v, dict):
        out += [(path, "required", n) for n in schema.get("required", []) if n not in v]
        for n, sub in schema.get("properties", {}).items():
            if n in v:
                out += plain(v[n], sub, root, below(n))
        for n in v:
            if n not in schema.get("properties", {}):
                out += plain(v[n], schema.get("additionalProperties", True), root, below(n))
    if isinstance(v, list) and "items" in schema:
        for i, x in enumerate(v):
            out += plain(x, schema["items"], root, below(str(i)))
    if "oneOf" in schema and sum(not plain(v, s, root, path) for s in schema["oneOf"]) != 1:
        out.append((path, "oneOf", str(len(schema["oneOf"]))))
    return out


def compare(spark, docs, schema):
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)]
    got = {i: [] for i, _ in rows}
    for r in J.findings(spark.createDataFrame(rows, "path long, value string"), schema).collect():
        got[r["path"]].append((r["at"], r["rule"], r["detail"]))
    for i, d in enumerate(docs):
        assert sorted(got[i]) == sorted(plain(d, schema, schema)), d


ODD = [None, True, 0, 1, -2, 1.5, 3.0, "", "ab", "Größe", [], [1], {}, {"a": 1}]
WORDS = ["role-x", "skills", "x", "", "high", "project", "document", "work:a", "doc:b", "work", "active", "agents/knowledge-graphs/a.json", "knowledge", "master", "behaviors", "project-graph"]


def random_value(rng, schema, root):
    """Mostly a value that keeps the schema, sometimes anything."""
    if rng.random() < 0.08:
        return rng.choice(ODD)
    if "$ref" in schema:
        return random_value(rng, root["definitions"][schema["$ref"].rpartition("/")[2]], root)
    if "const" in schema:
        return schema["const"] if rng.random() < 0.9 else rng.choice(WORDS)
    if "enum" in schema:
        return rng.choice([*schema["enum"], *WORDS[:2]])
    if "oneOf" in schema and "properties" not in schema:
        return random_value(rng, rng.choice(schema["oneOf"]), root)
    kind = schema.get("type", "object")
    if isinstance(kind, list):
        kind = rng.choice(kind)
    if kind == "string":
        return rng.choice(WORDS)
    if kind == "array":
        return [random_value(rng, schema.get("items", {"type": "string"}), root) for _ in range(rng.randint(0, 3))]
    if kind == "object":
        out = {n: random_value(rng, s, root) for n, s in schema.get("properties", {}).items() if n in schema.get("required", []) or rng.random() < 0.6}
        if rng.random() < 0.3 and out:
            out.pop(rng.choice(list(out)))
        return out | ({"extra": rng.choice([*ODD, ["a"]])} if rng.random() < 0.3 else {})
    return rng.choice(ODD)


@pytest.mark.parametrize("kind", list(J.SCHEMAS))
def test_graph_schemas_on_random_documents(spark, kind):
    rng, schema = random.Random(kind), J.SCHEMAS[kind]
    compare(spark, [random_value(rng, schema, schema) for _ in range(60)], schema)


def test_keywords_on_all_types(spark):
    for schema in (
        {"type": "integer"}, {"type": ["number", "null"]}, {"type": "boolean"}, {"type": "array", "items": {"type": "string", "minLength": 2}}, {"const": {"a": 1}}, {"const": None}, {"enum": [1, "ab", None, [1]]},
        {"pattern": "^.{2}$"}, {"minLength": 3}, {"required": ["a"]}, {"additionalProperties": False}, {"properties": {"a": False}}, {"oneOf": [{"type": "string"}, {"minLength": 1}]}, {"additionalProperties": {"type": "string"}}, True, {},
    ):
        compare(spark, ODD, schema)


def test_refused_schemas():
    for schema in ({"maximum": 3}, {"$ref": "http://x"}, {"properties": {"a": {"$ref": "#/definitions/a"}}, "definitions": {"a": {"items": {"$ref": "#/definitions/a"}}}}, {"type": "text"}):
        with pytest.raises((ValueError, TypeError)):
            J.compile_schema(schema)(F.lit(None)) if schema.get("type") else J.compile_schema(schema)


def test_targets(spark):
    good = {"graphType": "skills", "role": "role-b", "generatedAt": "2026-01-01", "skills": [{"id": "s", "links": {"uses": ["x"]}}]}
    bad = good | {"role": "b", "skills": [{"id": "s"}, {"id": "", "path": 3, "links": {"uses": [1]}}]}
    files = [("kg/builder-skills-graph.json", json.dumps(good)), ("kg/domain-skills-graph.json", json.dumps(bad)), ("kg/master-graph.json", "{"), ("kg/other.json", "{}")]
    found = J.validate_targets(spark.createDataFrame(files, "path string, value string")).persist()
    rows = {(r["target"], r["at"], r["rule"]) for r in found.collect()}
    assert {r for r in rows if r[0] == "domain-skills"} == {("domain-skills", "role", "pattern"), ("domain-skills", "skills/1/id", "minLength"), ("domain-skills", "skills/1/path", "type"), ("domain-skills", "skills/1/links/uses/0", "type")}
    assert ("master", "(root)", "parse") in rows and {t for t, _, rule in rows if rule == "missing"} == {"builder-knowledge", "builder-behaviors", "domain-behaviors", "domain-docs"}
    summary = {r["target"]: (r["passed"], r["n_findings"]) for r in J.validation_summary(found).collect()}
    assert len(summary) == 7 and summary["builder-skills"] == (True, 0) and summary["domain-skills"] == (False, 4) and summary["master"] == (False, 1)
    assert {r["target"] for r in J.validation_summary(J.validate_targets(spark.createDataFrame(files, "path string, value string"), ["master"]), ["master"]).collect()} == {"master"}
    found.unpersist()


def test_values_are_worked_out_once(spark):
    """An enum compares one text with all of its values, and nothing is worked out again to filter by the number of findings."""
    from tessera.plans import stored

    files = spark.createDataFrame([(1, '{"kind": "view", "amount": 1.5, "detail": {"k": 50}}'), (2, '{"kind": "x", "amount": 1, "detail": {"k": 3}}'), (3, "{"), (4, None)], "id int, value string")
    found = J.findings(files, stored.EVENT_SCHEMA, key="id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_parse_json") <= 2 and plan.lower().count("to_json") < 20
    assert not any("transform(" in line for line in plan.splitlines() if "Filter" in line)
    got = sorted((r["id"], r["at"], r["rule"]) for r in found.collect())
    assert got == [(1, "detail/k", "enum"), (1, "kind", "minLength"), (2, "amount", "oneOf"), (2, "kind", "enum"), (2, "kind", "minLength"), (3, "(root)", "parse"), (4, "(root)", "missing")]


def test_enums_of_odd_values(spark):
    values = ["a\"b", "é", "\t", 1.0, 10, True, None, {"a": [1]}, 1 << 64]
    check = J.compile_schema({"enum": values})
    texts = [json.dumps(v) for v in values] + ["11", '"a"', "false", "{}"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["n"] for r in rows.select("i", F.size(check(F.parse_json("t"))).alias("n")).collect()}
    assert got == {i: int(i >= len(values)) for i in range(len(texts))}
