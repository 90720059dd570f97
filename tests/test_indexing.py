from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tessera.operators import batching, graph, indexing

HISTORY = "node_id string, node_type string, graph string, title string, attributes string, source_path string, content_hash string, valid_from timestamp_ntz, superseded_at timestamp_ntz"
ITEM = "spec_no int, pos int, graph string, source_file string, default_type string, item string"


def at(day):
    return F.lit(datetime(2026, 1, day).isoformat(" ")).cast("timestamp_ntz")


def test_index_is_incremental(spark):
    seen = []

    def fn(texts):
        return batching.hashing_embedder(4)(texts)

    turns = spark.createDataFrame([(1, i, "human", f"turn {i} with a good many words in it, enough") for i in range(1, 8)], "conv_id long, seq int, role string, text string")
    empty = spark.createDataFrame([], "id string, content_sha256 string, embedding array<float>")
    first, actions = indexing.update_index(turns, empty, fn)
    assert {r["action"] for r in actions.collect()} == {"insert"} and not seen
    first = first.select("id", "content_sha256", "embedding").persist()
    again, actions = indexing.update_index(turns, first, fn)
    assert {r["action"] for r in actions.collect()} == {"unchanged"}
    assert sorted(map(tuple, again.select("id", "embedding").collect())) == sorted(map(tuple, first.select("id", "embedding").collect()))
    changed, actions = indexing.update_index(turns.filter("seq < 7"), first, fn)
    assert {"delete", "insert"} <= {r["action"] for r in actions.collect()} and changed.filter("embedding is null").count() == 0
    bare, _ = indexing.update_index(turns, empty)
    assert bare.filter("embedding is not null").count() == 0


def test_graph_sync(spark):
    items = spark.createDataFrame([(0, 0, "domain", "f", "skill", '{"id":"skills-root","name":"Root"}'), (0, 1, "domain", "f", "skill", '{"id":"a","name":"A","path":"docs/a.md","links":["skills-root"]}')], ITEM)
    none = spark.createDataFrame([], ITEM)
    docs = spark.createDataFrame([(1, "./docs/a.md", "t"), (2, "agents/skills/x.md", None), (3, "docs/plan/p.md", "p")], "doc_id long, path string, title string")
    edges = spark.createDataFrame([("x", "y", "links", "domain"), ("x", "z", "links", None)], "src_id string, dst_id string, edge_type string, graph string")
    one = indexing.sync_graph(items, none, docs, spark.createDataFrame([], HISTORY), edges, at(1))
    history = one["history"].persist()
    assert {r["node_id"] for r in history.collect()} == {"skills-root", "a", "stub-2"}
    assert {(r["src_id"], r["dst_id"], r["edge_type"], r["graph"]) for r in one["edges"].collect()} == {("x", "z", "links", None), ("a", "skills-root", "links", "domain"), ("stub-2", "skills-root", "in_domain", "structural")}
    assert tuple(one["coverage"].first()) == (3, 2, 1, 1)
    two = indexing.sync_graph(items, none, docs, history, one["edges"], at(2))
    assert sorted(map(tuple, two["history"].collect()), key=repr) == sorted(map(tuple, history.collect()), key=repr)
    assert sorted(map(tuple, two["edges"].collect()), key=repr) == sorted(map(tuple, one["edges"].collect()), key=repr)
    owned = items.unionByName(spark.createDataFrame([(0, 2, "domain", "f", "skill", '{"id":"b","path":"agents/skills/x.md"}')], ITEM))
    three = indexing.sync_graph(owned, none, docs, history, one["edges"], at(3))["history"]
    assert three.filter("node_id = 'stub-2' and superseded_at is not null").count() == 1 and three.filter("node_id = 'b' and superseded_at is null").count() == 1


def test_repair_stubs(spark):
    rows = [("stub-7", "docshare-stub", '{"tier":"stub","docshare_doc_id":"x"}'), ("stub-8", "docshare-stub", '{"docshare_doc_id":"8"}'), ("n", "domain", "{}"), ("stub-9", "docshare-stub", None)]
    fixed = {r["node_id"]: r["attributes"] for r in graph.repair_stub_docs(spark.createDataFrame(rows, "node_id string, graph string, attributes string")).collect()}
    assert fixed == {"stub-7": '{"tier":"stub","docshare_doc_id":"7"}', "stub-8": '{"docshare_doc_id":"8"}', "n": "{}", "stub-9": '{"docshare_doc_id":"9"}'}


def test_presentation(spark):
    def made(title, turns):
        df = spark.range(1).select(F.lit(title).alias("t") if title else F.lit(None).cast("map<string,string>").alias("t"), F.lit(None).cast("map<string,string>").alias("d"), F.from_json(F.lit(turns), "map<string,map<string,array<string>>>").alias("b"))
        return df.select(indexing.normalise_presentation(F.col("t"), F.col("d"), F.col("b")).alias("p")).first()["p"]

    title = F.create_map(F.lit("en"), F.lit(" Hi "), F.lit("xx"), F.lit("no"), F.lit("es"), F.lit(" "))
    df = spark.range(1).select(indexing.normalise_presentation(title, F.lit(None).cast("map<string,string>"), F.lit(None).cast("map<string,map<string,array<string>>>")).alias("p"))
    assert df.first()["p"]["title"] == {"en": "Hi"}
    assert made(None, '{"fr":{"1":["x"]}}') is None
    assert made(None, '{"en":{"1":["x"]},"original":{"1":["y"]}}')["turns"] == {"en": {"1": ["x"]}}
