"""Published versions, tables kept in step with their source, and the inverted index."""

from __future__ import annotations

import random
import shutil
import threading
from collections import Counter
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import batching, graph, merging, postings, retrieval, sessions, staging, synced
from tessera.plans import derive, registry
from tessera.plans import kept as kept_plans
from tessera.sources import snapshots, tables

SF = "/root/testdata/sf0.001"


# --- versions ---------------------------------------------------------------------------------


def rows_of(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def test_second_writer_of_a_version_is_told(spark, tmp_path):
    base = f"file://{tmp_path}/t"
    assert snapshots.commit(rows_of(spark, 1), base, 0) == 1
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(rows_of(spark, 2), base, 0)
    assert [r["id"] for r in snapshots.read(spark, base).collect()] == [1]
    assert len(list((tmp_path / "t").glob("data-*"))) == 1  # what the second wrote is gone


def test_created_once_by_many(spark, tmp_path):
    won = []

    def create(k):
        if snapshots.create_absent(spark, f"file://{tmp_path}/pointer", f"writer {k}"):
            won.append(k)

    threads = [threading.Thread(target=create, args=(k,)) for k in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and snapshots.read_text(spark, f"file://{tmp_path}/pointer") == f"writer {won[0]}"


def test_two_writers_lose_no_row(spark, tmp_path):
    base = f"file://{tmp_path}/t"
    snapshots.commit(rows_of(spark, 0), base, 0)
    gate = threading.Barrier(2)
    first = {1: True, 2: True}

    def add(k):
        def change(old):
            new = old.unionByName(rows_of(spark, k))
            if first.pop(k, False):
                gate.wait(60)  # both have read version 1
            return new

        snapshots.update(spark, base, change)

    threads = [threading.Thread(target=add, args=(k,)) for k in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r["id"] for r in snapshots.read(spark, base).collect()) == [0, 1, 2]
    assert snapshots.newest(spark, base) == 3 and sorted(r["version"] for r in snapshots.log(spark, base).collect()) == [1, 2, 3]


def test_winner_only_and_touched_keys(spark, tmp_path):
    base = f"file://{tmp_path}/t"
    snapshots.commit(rows_of(spark, 0), base, 0)
    seen = []

    def change(old):
        seen.append(1)
        if len(seen) == 1:  # another writer comes in between and touches key 7
            snapshots.commit(old.unionByName(rows_of(spark, 7)), base, 1, touched=rows_of(spark, 7))
        return old.unionByName(rows_of(spark, 8))

    assert snapshots.update(spark, base, change, touched=rows_of(spark, 7), winner_only=True) == 2 and len(seen) == 1
    assert snapshots.overlaps(spark, base, 1, rows_of(spark, 7)) and not snapshots.overlaps(spark, base, 1, rows_of(spark, 8))
    assert snapshots.update(spark, base, change, touched=rows_of(spark, 8), winner_only=True) == 3
    assert snapshots.update(spark, base, lambda old: None) == 3
    assert snapshots.expire(spark, base, keep=1) == 2
    assert sorted(r["id"] for r in snapshots.read(spark, base).collect()) == [0, 7, 8] and snapshots.newest(spark, base) == 3


def test_nothing_published(spark, tmp_path):
    assert snapshots.read(spark, f"file://{tmp_path}/none") is None
    with pytest.raises(FileNotFoundError):
        tables.published(spark, f"file://{tmp_path}/none")


def test_one_identity_is_opened_once(spark, tmp_path):
    base, now = f"file://{tmp_path}/s", F.lit(datetime(2026, 1, 1).isoformat(" ")).cast("timestamp_ntz")
    schema = "session_id long, agent_id string, operator_id string, workspace_key string, lane string, parent_session_id long, status string, updated_at timestamp_ntz"
    snapshots.commit(spark.createDataFrame([(1, "a", "o", "w", "x", None, "closed", datetime(2026, 1, 1))], schema), base, 0)

    def open_(k):
        asked = spark.createDataFrame([("a", "o", "w", "default", k, False)], "agent_id string, operator_id string, workspace_key string, lane string, new_id long, fork boolean")
        sessions.open_published(spark, base, asked, now)

    threads = [threading.Thread(target=open_, args=(k,)) for k in (10, 20)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    opened = snapshots.read(spark, base).filter("status = 'open'").collect()
    assert len(opened) == 1 and opened[0]["session_id"] in (10, 20)


# --- tables kept in step ----------------------------------------------------------------------


def kept(spark, base, rows, sign, buckets=4, check_every=0):
    """rows: {key: text}; every unit gives a row a word."""
    df = spark.createDataFrame(list(rows.items()), "k long, text string")
    loaded = []

    def derive(keys):
        own = df if keys is None else df.join(keys, "k", "left_semi")
        loaded.append(own.count())
        return own.select("k", F.explode(F.split("text", " ")).alias("word"))

    got = synced.sync(spark, base, lambda: sign, lambda: df.select("k", F.sha2("text", 256).alias("digest")), derive, "k", buckets, check_every)
    return sorted(map(tuple, got.rows.select("k", "word").collect())), got, loaded


def words(rows):
    return sorted((k, w) for k, t in rows.items() for w in t.split(" "))


def test_sync_reads_what_changed(spark, tmp_path):
    base = f"file://{tmp_path}/d"
    rows = {k: f"a{k} b{k}" for k in range(40)}
    got, state, loaded = kept(spark, base, rows, "1")
    assert got == words(rows) and loaded == [40] and state.stats["inserted"] == 40
    got, state, loaded = kept(spark, base, {1: "never read"}, "1")
    assert got == words(rows) and loaded == [] and state.stats["loaded"] == 0 and state.version == 1
    rows |= {3: "new text of three", 99: "one more"}
    got, state, loaded = kept(spark, base, rows, "2")
    assert got == words(rows) and loaded == [2] and (state.stats["inserted"], state.stats["updated"], state.stats["deleted"]) == (1, 1, 0) and state.stats["buckets"] <= 2
    for k in (5, 6):
        del rows[k]
    got, state, loaded = kept(spark, base, rows, "3")  # gone units are tombstones: no bucket is written
    assert got == words(rows) and loaded == [] and state.stats["deleted"] == 2 and state.stats["buckets"] == 0
    rows[5] = "back again"
    got, state, loaded = kept(spark, base, rows, "4")
    assert got == words(rows) and loaded == [1] and state.stats["inserted"] == 1
    rows = {k: t for k, t in rows.items() if k % 2}
    got, state, _ = kept(spark, base, rows, "5")  # so many tombstones that all is written anew
    assert got == words(rows) and state.stats["buckets"] == 4
    assert kept(spark, base, {}, "6")[0] == [] and kept(spark, base, {1: "x"}, "7")[0] == [(1, "x")]


def test_units_without_a_key_are_left_out(spark, tmp_path):
    base = f"file://{tmp_path}/d"
    assert kept(spark, base, {1: "x", None: "y"}, "1")[0] == [(1, "x")]
    assert kept(spark, base, {1: "z", None: "y"}, "2")[0] == [(1, "z")]
    docs = lambda *rows: (lambda: spark.createDataFrame(list(rows), "id long, content string"))
    for sign, rows in (("1", [(1, "alpha"), (None, "alpha"), (2, "beta")]), ("2", [(1, "alpha beta"), (None, "alpha"), (2, "beta")])):
        index = postings.sync(spark, f"file://{tmp_path}/i", lambda sign=sign: sign, docs(*rows), buckets=2)
    assert index.n_docs == 2 and [r["id"] for r in index.search(["alpha"]).collect()] == [1] and index.search(["beta"]).count() == 0


def test_sync_within_the_interval(spark, tmp_path):
    base = f"file://{tmp_path}/d"
    kept(spark, base, {1: "x"}, "1")
    assert kept(spark, base, {1: "y"}, "2", check_every=3600)[0] == [(1, "x")]
    assert kept(spark, base, {1: "y"}, "2")[0] == [(1, "y")]


def test_sync_random_changes(spark, tmp_path):
    rng, base, rows = random.Random(3), f"file://{tmp_path}/d", {}
    for step in range(5):
        for _ in range(8):
            k = rng.randint(0, 15)
            if rng.random() < 0.3:
                rows.pop(k, None)
            else:
                rows[k] = " ".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
        assert kept(spark, base, rows, str(step))[0] == words(rows)


@pytest.fixture
def own_tables(tmp_path):
    d = tmp_path / "sf"
    d.mkdir()
    for name in ("conversations", "embeddings"):
        shutil.copy(f"{SF}/{name}.parquet", d)
    return str(d)


def test_searches_follow_their_tables(spark, own_tables):
    search = registry.QUERIES["hybrid_search"]
    before = derive.items(spark, own_tables).count()
    one = [r["id"] for r in search(spark, own_tables).orderBy("place").collect()]
    held = spark.read.parquet(f"{own_tables}/conversations.parquet")
    held.unionByName(held.withColumn("conv_id", F.col("conv_id") + 1_000_000)).write.parquet(f"{own_tables}/both")
    Path(f"{own_tables}/conversations.parquet").unlink()
    shutil.move(f"{own_tables}/both", f"{own_tables}/conversations.parquet")
    state = derive.synced_items(spark, own_tables)
    assert state.rows.count() == 2 * before and state.stats["updated"] == state.stats["deleted"] == 0
    assert len(search(spark, own_tables).collect()) == len(one)
    staging.clear(spark)
    assert len(search(spark, own_tables).collect()) == len(one)
    assert registry.QUERIES["channel_search"](spark, own_tables).count() == len(one)


def test_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    """The memory of the task that writes a bucket must not grow with the table."""
    base, named = f"file://{tmp_path}/s", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    held = spark.conf.get(named)
    spark.conf.set(named, "64k")
    try:
        rows = spark.range(0, 4000, 1, 8).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
        done = synced.sync(spark, base, lambda: "1", lambda: rows.select("k", F.lit("d").alias("digest")), lambda keys: rows, "k", 2)
    finally:
        spark.conf.set(named, held)
    files = [str(f) for f in Path(f"{tmp_path}/s").rglob("*.parquet") if "/rows/" in str(f)]
    assert all(sum(f"_bucket={b}/" in f for f in files) > 1 for b in (0, 1)), files
    assert done.rows.count() == done.rows.select("k").distinct().count() == 4000


# --- the inverted index -----------------------------------------------------------------------


def plain_scores(docs, tokens, split):
    import math

    held = {i: Counter(split(t or "")) for i, t in docs.items()}
    out = Counter()
    for t in tokens:
        df = sum(t in c for c in held.values())
        for i, c in held.items():
            if c[t]:
                out[i] += c[t] * math.log10(len(docs) / df) ** 2
    return {i: round(s, 6) for i, s in out.items() if round(s, 9) > 0}


def split_words(text):
    import re

    return [w for w in re.split("[^a-z0-9_./:@-]+", text.lower()) if len(w) >= 2]


def index_of(spark, base, docs, sign):
    return postings.sync(spark, base, lambda: sign, lambda: spark.createDataFrame(list(docs.items()), "id long, content string"), buckets=8)


def test_index_follows_its_texts(spark, tmp_path):
    rng, base, docs = random.Random(1), f"file://{tmp_path}/i", {}
    some = ["alpha", "beta", "a.b", "x-y", "gamma", "会議記録", "録会", "z"]
    segments = []
    for step in range(6):
        for _ in range(10):
            k = rng.randint(0, 25)
            if rng.random() < 0.25:
                docs.pop(k, None)
            else:
                docs[k] = None if rng.random() < 0.1 else " ".join(rng.choice(some) for _ in range(rng.randint(0, 6)))
        index = index_of(spark, base, docs, str(step))
        segments.append(index.stats["segments"])
        assert index.n_docs == len(docs)
        got = {r["id"]: round(r["score"], 6) for r in index.search(["alpha", "a.b", "none"]).collect()}
        assert got == pytest.approx(plain_scores(docs, ["alpha", "a.b"], split_words))
        pairs = lambda t: [r[i : i + 2] for r in t.split(" ") if r[0:1] > "z" for i in range(len(r) - 1)]
        got = {r["id"]: round(r["score"], 6) for r in index.search(["会議", "記録"], postings.CJK).collect()}
        assert got == pytest.approx(plain_scores(docs, ["会議", "記録"], pairs))
    assert max(segments) < postings.FANOUT and 1 in segments[1:]  # merged on the way


def test_search_reads_only_its_buckets(spark, tmp_path):
    index = index_of(spark, f"file://{tmp_path}/i", {i: f"alpha beta{i} gamma{i}" for i in range(50)} | {99: "delta"}, "1")
    found = index.search(["alpha"])
    plan = found._jdf.queryExecution().toString()
    assert "content" not in plan and "PushedFilters: [IsNotNull(field)" in plan.replace("DataFilters", "")
    files = found.inputFiles()
    assert files and len({f.split("_bucket=")[1].split("/")[0] for f in files}) == 1
    assert found.count() == 50 and index.search([]).count() == 0 and index.search(["nowhere"]).count() == 0


def test_unchanged_texts_are_not_read(spark, tmp_path):
    base = f"file://{tmp_path}/i"
    index_of(spark, base, {1: "alpha"}, "1")
    again = postings.sync(spark, base, lambda: "1", lambda: 1 / 0)
    assert again.n_docs == 1 and again.stats["inserted"] == 0


def test_terms_are_counted_where_texts_are_read(spark):
    texts = ["", None, "a b-c b-c. B-C", "会議記録会議 x", "会 議a録会録会", "𠀀会議𠀀録", "ひらカナ한글 中文中文中文", "\u212aeep \u0130n x\u0131y A\u030aB", "e\u0301t\u00e9 ab\nab\u2028ab", "word " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    found = postings.terms(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan, "counted by a shuffle of a row a word"
    words = {r["id"]: r["w"] for r in docs.select("id", postings.words_of(F.col("content")).alias("w")).collect()}
    runs = {r["id"]: r["r"] for r in docs.select("id", T.cjk_run_list(F.col("content")).alias("r")).collect()}
    want = {(postings.WORD, w, i, n) for i, ws in words.items() for w, n in Counter(ws).items()}
    want |= {(postings.CJK, p, i, n) for i, rs in runs.items() for p, n in Counter(r[k : k + 2] for r in rs for k in range(len(r) - 1)).items()}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) and (postings.CJK, "中文", 6, 3) in want


def test_made_texts_are_made_once(spark):
    """Both states of the index read the stored texts: only the staged table's plan translates."""
    made = []
    real, kept_plans.staged = kept_plans.staged, lambda df, name: made.append(name) or staging.staged(df, name)
    try:
        found = registry.QUERIES["cjk_search"](spark, SF)
    finally:
        kept_plans.staged = real
    assert made == ["cjk-documents"] and found.count() > 0


def test_cjk_hits_come_after_word_hits(spark, tmp_path):
    docs = {1: "alpha other words of it", 2: "会議記録", 3: "alpha 会議", 4: "nothing here"}
    items = spark.createDataFrame([(i, i, "window", t, [1.0, 0.0]) for i, t in docs.items()], "id long, conv_id long, granularity string, content string, embedding array<float>")
    index = postings.sync(spark, f"file://{tmp_path}/i", lambda: "1", lambda: items.select("id", "content"), buckets=4)
    hits = retrieval.channel_search(items, "alpha 会議", None, index=index).orderBy("place").collect()
    assert [r["id"] for r in hits] == [1, 3, 2]
    only = retrieval.archive_search(items.withColumn("workspace_key", F.when(F.col("id") == 1, "w")), "alpha 会議", workspace_key="w", mode="channels", index=index)
    assert [r["id"] for r in only.collect()] == [1]


# --- edges ------------------------------------------------------------------------------------


def test_structural_edges_are_replaced_by_one_sort(spark):
    schema = "src_id string, dst_id string, edge_type string, graph string"
    old = [("a", "b", "t", "domain"), ("a", "b", "t", None), ("c", "d", "t", "domain"), ("c", "d", "t", "domain"), ("e", "f", "t", "structural"), ("g", None, "t", "domain"), ("h", "i", "t", None)]
    new = [("a", "b", "t", "x"), ("a", "b", "t", None), ("g", None, "t", "x"), ("g", None, "t", "x"), ("n", "m", "t", None)]
    done = graph.replace_edges(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), structural=True)
    plan = done._jdf.queryExecution().executedPlan().toString()
    want = [("a", "b", "t", "structural"), ("c", "d", "t", "domain"), ("c", "d", "t", "domain"), ("g", None, "t", "domain"), ("g", None, "t", "structural"), ("h", "i", "t", None), ("n", "m", "t", "structural")]
    assert Counter(tuple(r) for r in done.collect()) == Counter(want)
    assert "Join" not in plan and plan.count("Sort [") == 1, "a task holds both sides and their classes at once"


# --- merges -----------------------------------------------------------------------------------


def test_rows_without_a_digest(spark):
    a = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, None)], "id long, content_sha256 string")
    b = spark.createDataFrame([(2, None), (3, None), (4, "y"), (5, None)], "id long, content_sha256 string")
    got = {r["id"]: r["action"] for r in merging.diff_by_key(a, b, ["id"]).collect()}
    assert got == {1: "insert", 2: "unchanged", 3: "update", 4: "update", 5: "delete"}


def test_chunks_of_a_node_add_up(spark):
    schema = "id long, node_id string, embedding array<float>"
    kg = spark.createDataFrame([(1, "n1", [1.0, 0.0]), (2, "n2", [0.9, 0.1]), (3, "n1", [0.8, 0.2]), (4, None, [0.1, 0.9])], schema)
    docs = spark.createDataFrame([(7, None, [1.0, 0.0])], schema)
    got = {r["key"]: (r["score"], r["fused"]) for r in retrieval.joint_search(kg, docs, [1.0, 0.0], node="node_id").collect()}
    assert set(got) == {"kg:n1", "kg:n2", "kg:4", "doc:7"}
    assert got["kg:n1"] == (1.0, round(1 / 61 + 1 / 63, 10)) and got["doc:7"][1] == round(1 / 61, 10)
    assert len(retrieval.joint_search(kg, docs, [1.0, 0.0], node="node_id", use_rrf=False, floor=0.0).collect()) == 5
    assert retrieval.joint_search(kg, docs, None).collect() == []
    assert [retrieval.joint_mode(*x) for x in (("", [1.0]), ("q", None), ("q", [1.0]), ("q", [1.0], False))] == ["empty", "no_embed", "rrf", "cosine"]


def test_repaired_answers(spark):
    fence = "```"
    texts = ['<THINK>{"z": 1}</THINK>{"a": "x"}', f'{{"a": "code {fence}json x{fence} end"}}', f'{fence}json\n{{"a": "y"}}\n{fence}', f'<think>a\nb</think>\n{fence}\n{{"a": "z"}}{fence}']
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", batching.repair_json(F.col("t")).alias("m")).orderBy("i").collect()
    assert [r["m"] for r in got] == [{"a": "x"}, {"a": f"code {fence}json x{fence} end"}, {"a": "y"}, {"a": "z"}]


def test_attributes_keep_their_types(spark):
    import json

    rows = [("stub-1", "docshare-stub", '{"n": 1, "o": {"b": [1, 2]}, "t": true, "z": null, "s": "q\\"x", "docshare_doc_id": "9"}'), ("stub-2", "docshare-stub", None), ("stub-3", "docshare-stub", "[1]"), ("stub-4", "docshare-stub", '{"docshare_doc_id": "4", "n": 1.5}'), ("n", "domain", '{"n": 2}')]
    got = {r["node_id"]: r["attributes"] for r in graph.repair_stub_docs(spark.createDataFrame(rows, "node_id string, graph string, attributes string")).collect()}
    assert json.loads(got["stub-1"]) == {"n": 1, "o": {"b": [1, 2]}, "t": True, "z": None, "s": 'q"x', "docshare_doc_id": "1"}
    assert json.loads(got["stub-2"]) == {"docshare_doc_id": "2"} and json.loads(got["stub-3"]) == {"docshare_doc_id": "3"}
    assert got["stub-4"] == rows[3][2] and got["n"] == rows[4][2]
