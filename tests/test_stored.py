"""Stored forms, memoised embedding and trees in reading order."""

from __future__ import annotations

import json
import random
import struct
import zlib
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import codecs
from tessera.operators import batching, forest, memo


# --- codecs -----------------------------------------------------------------------------------


def test_vectors_are_little_endian_floats(spark):
    rows = [(1, [1.0, -2.5]), (2, []), (3, None), (4, [0.1])]
    got = {r["i"]: r["b"] for r in spark.createDataFrame(rows, "i int, v array<float>").select("i", codecs.pack_vector(F.col("v")).alias("b")).collect()}
    assert got == {1: struct.pack("<2f", 1.0, -2.5), 2: None, 3: None, 4: struct.pack("<f", 0.1)}
    blobs = [(1, got[1]), (2, got[1][:-1]), (3, b""), (4, None), (5, got[4])]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in blobs], "i int, b binary")
    assert {r["i"]: r["v"] for r in df.select("i", codecs.unpack_vector(F.col("b")).alias("v")).collect()} == {1: [1.0, -2.5], 2: None, 3: None, 4: None, 5: pytest.approx([0.1])}
    assert {r["i"]: r["v"] is not None for r in df.select("i", codecs.unpack_vector(F.col("b"), 2).alias("v")).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_documents_round_trip(spark):
    doc = {
        "schema": 1, "source_host": "h", "source_ref": "r", "title": "ÄÖ 会議", "redaction_count": 2, "title_hint": "t",
        "turns": [{"seq": 1, "role": "human", "blocks": [{"type": "text", "text": "a\n\"b\"\\"}]}, {"seq": 2, "role": "agent", "blocks": [{"type": "tool_use", "tool_name": "x", "tool_input": "k=1"}, {"type": "text", "text": ""}]}],
    }
    bodies = [zlib.compress(json.dumps(doc).encode(), 6), zlib.compress(json.dumps(doc).encode(), 6)[:-7], b"no stream", None, zlib.compress(b"{"), zlib.compress(b"\xff\xfe"), zlib.compress(b"{}"), zlib.compress(b'{"turns": []}')]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(bodies)], "i int, body binary")
    got = {r["i"]: r["doc"] for r in df.select("i", codecs.document_of(F.col("body")).alias("doc")).collect()}
    plain = got[0].asDict(True)
    for t in plain["turns"]:
        t["blocks"] = [{k: v for k, v in b.items() if v is not None} for b in t["blocks"]]
    assert plain == doc
    assert [got[i] for i in (1, 2, 3, 4, 5)] == [None] * 5
    assert got[7].asDict(True) == {"schema": None, "source_host": "unknown", "source_ref": "", "title": None, "redaction_count": 0, "turns": [], "title_hint": None}
    again = df.filter("i = 0").select(codecs.document_of(codecs.body_of(codecs.document_of(F.col("body")))).alias("doc")).first()["doc"]
    assert again == got[0]


def test_load_by_id_then_source_then_newest(spark):
    body = lambda n: bytearray(zlib.compress(json.dumps({"title": n, "turns": []}).encode()))
    rows = [("a", "s1", "w", datetime(2026, 1, 1), body("a")), ("b", "s2", "w", datetime(2026, 1, 3), body("b")), ("c", "s2", "w", datetime(2026, 1, 2), body("c")), ("d", "s3", "w", None, body("d")), ("e", "s4", "v", datetime(2026, 1, 1), bytearray(b"broken"))]
    archive = spark.createDataFrame(rows, "transcript_id string, source_ref string, workspace_key string, captured_at timestamp_ntz, body binary")
    title = lambda **how: [r["doc"] and r["doc"]["title"] for r in codecs.load_transcript(archive, **how).collect()]
    assert title(transcript_id="a", source_ref="s2") == ["a"] and title(source_ref="s2", workspace_key="v") == ["b"]
    assert title(workspace_key="w") == ["b"] and title(workspace_key="v") == [None] and title(transcript_id="none") == []
    with pytest.raises(ValueError):
        codecs.load_transcript(archive)
    assert {r["workspace_key"]: r["doc"] and r["doc"]["title"] for r in codecs.newest_transcripts(archive).collect()} == {"w": "b", "v": None}


# --- memoised embedding -----------------------------------------------------------------------


def counting(path):
    """A model that writes down what it is asked."""
    inner = batching.hashing_embedder(4)

    def fn(texts):
        with open(path, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return inner(texts)

    return fn


def test_each_text_is_embedded_once(spark, tmp_path):
    base, told = f"file://{tmp_path}/cache", f"{tmp_path}/told"
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["one", " one ", "two  words", "two words", "", None, "one"])], "i int, text string").repartition(3)
    got, stats = memo.embed(rows, base, "m", counting(told))
    assert sorted(open(told).read().split("\n")[:-1]) == ["one", "two words"]
    assert {r["i"]: r["embedding"] is not None for r in got.collect()} == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False, 6: True}
    assert (stats["asked"], stats["found"], stats["embedded"]) == (3, 0, 2)
    got, stats = memo.embed(rows.unionByName(spark.createDataFrame([(9, "three")], "i int, text string")), base, "m", counting(told))
    assert sorted(open(told).read().split("\n")[:-1]) == ["one", "three", "two words"] and (stats["found"], stats["embedded"]) == (2, 1)
    assert {r["i"]: r["hit"] for r in got.filter("embedding is not null").collect()} == {0: True, 1: True, 2: True, 3: True, 6: True, 9: False}
    memo.embed(rows, base, "other", counting(told))  # another model has keys of its own
    assert open(told).read().count("one\n") == 2


def test_failed_model_leaves_search_lexical(spark, tmp_path):
    base = f"file://{tmp_path}/cache"

    def broken(texts):
        raise RuntimeError("no model")

    assert memo.embed_query(spark, base, "m", broken, "a query") is None
    assert memo.embed_query(spark, base, "m", batching.hashing_embedder(4), "  ") is None
    vector = memo.embed_query(spark, base, "m", batching.hashing_embedder(4), "a query")
    assert vector and memo.embed_query(spark, base, "m", broken, " a  query ") == vector


def test_two_runs_remember_a_key_once(spark, tmp_path):
    base = f"file://{tmp_path}/cache"
    row = lambda *keys: spark.createDataFrame([(k, "m", 1, "t", [1.0]) for k in keys], memo.CACHE)
    assert memo.remember(row("a", "b", "a"), base) == 2 and memo.remember(row("b", "c"), base) == 1 and memo.remember(row("a"), base) == 0
    for i in range(memo.MOST_PARTS + 2):
        memo.remember(row(f"k{i}"), base)
    keys = [r["key"] for r in memo.cached(spark, base).collect()]
    assert len(keys) == len(set(keys)) == 3 + memo.MOST_PARTS + 2


# --- trees ------------------------------------------------------------------------------------


def plain_preorder(rows):
    """rows: (id, parent, at)."""
    ids = {i for i, _, _ in rows}
    kin = {}
    for i, p, at in sorted(rows, key=lambda r: (r[2], r[0])):
        kin.setdefault(p if p in ids else None, []).append(i)
    out = {}

    def walk(root):
        stack, n = [(root, 0, str(root))], 0
        order = []
        while stack:
            i, depth, path = stack.pop()
            out[i] = [root, depth, n, 1, path]
            n += 1
            order.append(i)
            stack += [(c, depth + 1, f"{path}/{c}") for c in reversed(kin.get(i, []))]
        parent = {i: p for i, p, _ in rows}
        for i in reversed(order):
            if i != root:
                out[parent[i]][3] += out[i][3]

    for root in kin.get(None, []):
        walk(root)
    return {i: tuple(out.get(i, (None,) * 5)) for i in ids}


def ordered(spark, rows, path=True):
    nodes = spark.createDataFrame(rows, "id long, up long, at long")
    got = forest.preorder(nodes, "id", "up", "at", path=path).collect()
    return {r["id"]: (r["root"], r["depth"], r["position"], r["size"]) + ((r["path"],) if path else ()) for r in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forest_with_loops(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, 999, *range(max(0, i - 12), i)]) if i else None, rng.randint(0, 3)) for i in range(80)]
    rows += [(100, 101, 0), (101, 100, 0), (102, 101, 0), (103, 103, 0)]  # loops, one below, one of its own
    want = plain_preorder(rows)
    assert ordered(spark, rows) == want and [want[i] for i in (100, 101, 102, 103)] == [(None,) * 5] * 4


def test_long_chain(spark):
    n = 10_000
    got = ordered(spark, [(i, i - 1 if i else None, 0) for i in range(n)], path=False)
    assert got == {i: (0, i, i, n - i) for i in range(n)}


def test_wide_star(spark):
    n = 100_000
    nodes = spark.range(n).select("id", F.when(F.col("id") > 0, 0).cast("long").alias("up"), (-F.col("id")).alias("at"))
    got = forest.preorder(nodes, "id", "up", "at", path=False)
    assert got.filter((F.col("id") == 0) & (F.col("size") == n) & (F.col("position") == 0)).count() == 1
    assert got.filter((F.col("id") > 0) & (F.col("size") == 1) & (F.col("position") == n - F.col("id")) & (F.col("depth") == 1)).count() == n - 1


def test_empty_forest(spark):
    assert ordered(spark, []) == {}


def test_texts_go_on_before_a_batch_is_inflated(spark):
    """A batch of well deflated bodies isn't inflated as a whole."""
    rows = [(i, None if i % 5 == 4 else zlib.compress((f"{i} " * 2000).encode())[: -5 if i % 5 == 3 else None]) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, body binary").coalesce(1)
    got = codecs.inflated(df, "body", 20_000)
    want = {i: f"{i} " * 2000 if i % 5 < 3 else None for i, _ in rows}
    assert {r["i"]: r["body"] for r in got.collect()} == want
    assert {r["i"]: r["t"] for r in df.select("i", codecs.inflate(F.col("body")).alias("t")).collect()} == want
    bodies = pa.array([r[1] for r in rows], pa.binary())
    parts = list(codecs._parts(iter([pa.RecordBatch.from_arrays([bodies], ["body"])]), "body", 20_000))
    assert sum(p.num_rows for p in parts) == 40 and max(p.nbytes for p in parts) < 40_000
    assert codecs.inflated(df.limit(0), "body").count() == 0
    plan = codecs.with_documents(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
