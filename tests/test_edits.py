"""Edits of JSON texts, statuses and times on rows that are odd."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from tessera.functions import times
from tessera.operators import graph, sessions
from tessera.sources import knowledge


def test_members_keep_their_types(spark):
    texts = ['{"b": [1, 2.5, "x"], "a": {"k": null}, "t": true}', "{}", None, "[1]", "{", '{"new": 1, "ä\\"ö": "q"}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: json.loads(r["j"]) for r in df.select("i", graph.with_json(F.col("t"), new=F.lit('{"x": [null]}'), more=F.lit("2")).alias("j")).collect()}
    new = {"new": {"x": [None]}, "more": 2}
    assert got == {0: json.loads(texts[0]) | new, 1: new, 2: new, 3: new, 4: new, 5: {'ä"ö': "q"} | new}


def test_both_sides_of_a_link(spark):
    nodes = spark.createDataFrame([("n1", "domain", "docs/a.md", '{"docshare_doc_id": "1"}'), ("n2", "domain", "./docs/a.md", '{"n": 1}'), ("n3", "domain", None, None), ("n4", "domain", "docs/z.md", None)], "node_id string, graph string, source_path string, attributes string")
    docs = spark.createDataFrame([(1, "docs/a.md", "{}"), (2, "docs\\a.md", None), (3, "docs/none.md", '{"kg_indexed": true}'), (4, None, "x")], "doc_id long, path string, metadata_json string")
    got = {r["node_id"]: r["attributes"] for r in graph.backlink_nodes(nodes, docs).collect()}
    assert json.loads(got.pop("n2")) == {"n": 1, "docshare_doc_id": "2"} and got == {"n1": '{"docshare_doc_id": "1"}', "n3": None, "n4": None}
    linked = graph.linked_metadata(docs, nodes).select("doc_id", "metadata_json", graph.is_indexed(F.col("metadata_json")).alias("on")).collect()
    assert {r["doc_id"]: (json.loads(r["metadata_json"]), r["on"]) for r in linked} == {
        1: ({"kg_node_id": "n2", "kg_indexed": True}, True), 2: ({"kg_node_id": "n2", "kg_indexed": True}, True), 3: ({"kg_node_id": None, "kg_indexed": False}, False), 4: ({"kg_node_id": None, "kg_indexed": False}, False),
    }


def test_contains_of_any_kind(spark):
    texts = ['["a", {"name": "n", "value": "v"}, {"name": "n"}, {"value": 3}, {"name": "", "description": "d"}, {}, 5, null, ["x"], ""]', "[]", None, "{}", "no"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {r["i"]: r["x"] for r in df.select("i", knowledge.contains_text(F.col("t")).alias("x")).collect()} == {0: "a\nn: v\nn\n3\nd\n", 1: "", 2: "", 3: "", 4: ""}


def test_local_times(spark):
    rows = [("2026-07-01T12:00:00Z", 0.5), ("2026-07-01T12:00:00+05:30", None), ("2026-07-01 12:00:00.25-0800", 1.0), ("2026-01-01T00:30:00", 1767225600.0), ("2026-01-01", 0.0), ("no time", 0.0), (None, 0.0)]
    got = spark.createDataFrame(rows, "t string, s double").select(times.of_text(F.col("t"), "Europe/Berlin").alias("t"), times.of_epoch(F.col("s"), "Europe/Berlin").alias("s")).collect()
    assert [r["t"] for r in got] == [datetime(2026, 7, 1, 14), datetime(2026, 7, 1, 8, 30), datetime(2026, 7, 1, 22, 0, 0, 250000), datetime(2026, 1, 1, 0, 30), datetime(2026, 1, 1), None, None]
    assert [r["s"] for r in got][:4] == [datetime(1970, 1, 1, 1, 0, 0, 500000), None, datetime(1970, 1, 1, 1, 0, 1), datetime(2026, 1, 1, 1)]


def test_statuses_and_presentations(spark):
    at, now = datetime(2026, 1, 1), F.lit("2026-02-01 00:00:00").cast("timestamp_ntz")
    held = spark.createDataFrame([(1, "open", at), (2, "open", at), (3, None, at)], "session_id long, status string, updated_at timestamp_ntz")
    changes = spark.createDataFrame([(1, "parked"), (2, "open"), (3, "closed"), (1, "nonsense"), (9, "open")], "session_id long, status string")
    got = {r["session_id"]: (r["status"], r["updated_at"].month) for r in sessions.change_statuses(held, changes, now).collect()}
    assert got == {1: ("parked", 2), 2: ("open", 1), 3: ("closed", 2)}
    kind = "title map<string,string>, description map<string,string>, turns map<string,map<string,array<string>>>"
    stored = spark.createDataFrame([("a", None), ("b", None)], f"transcript_id string, presentation struct<{kind.replace(' map', ': map')}>")
    told = spark.createDataFrame([("a", {"en": " x  y "}, None, {"es": {"1": ["z"]}}), ("c", {"en": "t"}, None, None)], f"transcript_id string, {kind}")
    out, unknown = sessions.set_presentations(stored, told)
    rows = {r["transcript_id"]: r["presentation"] for r in out.collect()}
    assert rows["a"]["title"] == {"en": "x y"} and rows["a"]["turns"] == {"es": {"1": ["z"]}} and rows["b"] is None
    assert [r["transcript_id"] for r in unknown.collect()] == ["c"]
