from __future__ import annotations

import json
import os
import time
from datetime import datetime

from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.sources import knowledge, tables, transcripts, trees
from tessera.streaming import live


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_nested_transcripts(spark, tmp_path):
    lines = [
        {"role": "user", "message": {"content": [{"type": "text", "text": "<user_query>\nwhere is the kettle\n</user_query>"}]}},
        {"type": "turn_ended"},
        {"role": "assistant", "message": {"content": [{"type": "text", "text": "password=plum7plum7plum"}, {"type": "tool_use", "name": "Measure", "input": {"width": 4, "by": "two metres"}}]}},
        {"role": "robot", "message": {"content": []}},
    ]
    write(f"{tmp_path}/my-repo/a.jsonl", "\n".join(map(json.dumps, lines)) + "\nnot json\n")
    found = transcripts.files(spark, str(tmp_path))
    rows = transcripts.read_nested(found).orderBy("seq").collect()
    assert [(r["seq"], r["role"]) for r in rows] == [(1, "human"), (2, "agent")]
    assert rows[0]["text"] == "where is the kettle" and rows[1]["redactions"] == 1
    assert rows[1]["tools"][0]["tool_name"] == "Measure" and rows[1]["tools"][0]["tool_input"] == "width=4, by=two metres"
    assert transcripts.discovered(found, "repo").count() == 1 and transcripts.discovered(found, "other").count() == 0


def test_typed_transcripts(spark, tmp_path):
    lines = [
        {"type": "user", "message": {"role": "user", "content": "plain"}},
        {"type": "user", "isMeta": True, "message": {"content": "meta"}},
        {"type": "assistant", "isSidechain": True, "message": {"content": "side"}},
        {"type": "assistant", "message": {"content": [{"type": "thinking", "text": "no"}]}},
        {"type": "ai-title", "aiTitle": "First"},
        {"type": "ai-title", "aiTitle": "Last"},
        {"type": "assistant", "message": {"content": [{"type": "text", "text": "answer"}]}},
    ]
    write(f"{tmp_path}/b.jsonl", "\n".join(map(json.dumps, lines)))
    found = transcripts.files(spark, str(tmp_path))
    assert [(r["seq"], r["role"], r["text"]) for r in transcripts.read_typed(found).orderBy("seq").collect()] == [(1, "human", "plain"), (2, "agent", "answer")]
    assert transcripts.title_hints(found).first()["title_hint"] == "Last"


def test_graph_files(spark, tmp_path):
    skill = {"id": "s1", "name": "Skill", "path": "./md/s1.md", "governed_by": ["b1", ""], "contains": ["x"], "status": "active"}
    files = {
        "domain-behaviors.json": {"behaviors": [{"id": "b1", "label": "B", "text": "long enough to be kept as a chunk"}, {"id": "b2", "status": "Archived"}]},
        "domain-skills-graph.json": {"skills": [skill, {"id": "b1", "name": "again", "links": ["s1"]}], "edges": [{"source": "s1", "target": "b1"}, {"from": "s1", "to": "b1", "type": "t"}]},
        "other.json": {"skills": [{"id": "no"}]},
    }
    for name, value in files.items():
        write(f"{tmp_path}/kg/{name}", json.dumps(value))
    write(f"{tmp_path}/md/s1.md", "---\na: b\n---\n" + "A body of more than thirty characters.\n")
    items = knowledge.graph_items(spark, f"{tmp_path}/kg")
    nodes = {r["node_id"]: r for r in graph.node_rows(items).collect()}
    assert set(nodes) == {"b1", "s1"} and nodes["b1"]["node_type"] == "behavior" and nodes["b1"]["title"] == "B" and nodes["s1"]["source_path"] == "md/s1.md"
    assert {(r["src_id"], r["dst_id"], r["edge_type"]) for r in graph.edge_rows(items).collect()} == {("s1", "b1", "governed_by"), ("s1", "x", "contains"), ("b1", "s1", "links")}
    listed = graph.listed_edges(knowledge.graph_items(spark, f"{tmp_path}/kg", "edges"))
    assert {(r["src_id"], r["dst_id"], r["edge_type"]) for r in listed.collect()} == {("s1", "b1", "related"), ("s1", "b1", "t")}
    chunks = {r["id"]: r for r in knowledge.chunks(items, knowledge.markdown(spark, f"{tmp_path}/md"), f"file://{tmp_path}/").collect()}
    assert chunks["kg:skill:s1"]["content_source"] == "markdown" and chunks["kg:behavior:b1"]["content_source"] == "json"


def test_text_tree(spark, tmp_path):
    write(f"{tmp_path}/a/x.md", "one")
    write(f"{tmp_path}/node_modules/y.md", "two")
    write(f"{tmp_path}/a/z.bin", "three")
    assert [r["text"] for r in trees.text_tree(spark, str(tmp_path)).collect()] == ["one"]


def test_snapshots(spark, tmp_path):
    base = f"file://{tmp_path}/t"
    tables.publish(spark.range(3).toDF("k"), base)
    time.sleep(0.01)
    tables.publish(spark.range(5).toDF("k"), base)
    assert tables.published(spark, base).count() == 5


def test_sql_parameters(spark):
    assert tables.query(spark, "select :a + 1 as x", a=2).first()["x"] == 3


def test_job_log_stream(spark, tmp_path):
    schema = "item long, ts timestamp, status string, bump boolean"
    for k, rows in enumerate(([(1, datetime(2026, 1, 1), "running", True), (2, datetime(2026, 1, 1), None, False)], [(1, datetime(2026, 1, 2), None, True), (2, datetime(2026, 1, 2), "completed", True)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log/{k}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    q = live.fold_job_log(stream).writeStream.outputMode("update").format("memory").queryName("job_log").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("job_log").groupBy("item").agg(F.max_by(F.struct("status", "attempt", "seq"), "seq").alias("s")).select("item", "s.*").collect()
    assert {tuple(r) for r in last} == {(1, "running", 2, 2), (2, "completed", 1, 2)}


def test_liveness_stream(spark, tmp_path):
    rows = [(1, "a", datetime(2026, 1, 1, h)) for h in (0, 1, 2, 9)] + [(1, "a", datetime(2026, 1, 3))]
    spark.createDataFrame(rows, "session_id long, host string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/beats")
    stream = spark.readStream.schema("session_id long, host string, ts timestamp").parquet(f"{tmp_path}/beats")
    q = live.liveness(stream, 240).writeStream.outputMode("append").format("memory").queryName("spells").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["beats"] for r in spark.table("spells").collect()) == [1, 3]


def test_capture_stream(spark, tmp_path):
    schema = "source_host string, source_ref string, content_sha256 string, session_id long, captured_at timestamp_ntz, title string"
    for k, rows in enumerate(([("a", "1", "h1", 5, datetime(2026, 1, 1), "one")], [("a", "1", "h2", None, datetime(2026, 1, 2), "two"), ("a", "2", "h3", 6, datetime(2026, 1, 2), "three")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = live.capture(stream, f"file://{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {r["source_ref"]: (r["content_sha256"], r["session_id"], r["title"]) for r in tables.published(spark, f"file://{tmp_path}/out").collect()}
    assert got == {"1": ("h2", 5, "two"), "2": ("h3", 6, "three")}
