from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import batching, chunking, fusion, graph, jobs, merging, quality, retrieval, sessions


def at():
    return F.lit("2026-01-10 00:00:00").cast("timestamp_ntz")


def turns(spark, n, skip=()):
    rows = [(1, i, "human" if i % 2 else "agent", "" if i in skip else f"turn number {i} with enough words to count") for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "conv_id long, seq int, role string, text string")


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 7, 8, 11, 20])
def test_windows(spark, n):
    size = min(5, n)
    starts = sorted({*range(0, n - size + 1, 3), n - size})
    got = sorted((r["seq_start"], r["seq_end"]) for r in chunking.windows(turns(spark, n)).collect())
    assert got == [(s + 1, s + size) for s in starts]


def test_windows_skip_turns_without_text(spark):
    got = chunking.windows(turns(spark, 3, skip={2})).collect()
    assert [(r["seq_start"], r["seq_end"]) for r in got] == [(1, 3)] and "[2]" not in got[0]["content"]
    assert chunking.windows(turns(spark, 3, skip={1, 2, 3})).collect() == []


def test_session_is_clipped(spark):
    long = turns(spark, 400)
    assert len(chunking.sessions(long).first()["content"]) == 6001


def test_session_ends_at_the_last_turn(spark):
    for n in (1, 3, 150, 158, 159, 160, 161, 400):
        rows = chunking.sessions(turns(spark, n)).first()
        body = "\n\n".join(f"[{i}] {'Human' if i % 2 else 'Agent'}: turn number {i} with enough words to count" for i in range(1, n + 1))
        assert (rows["seq_start"], rows["seq_end"], rows["content"]) == (1, n, body if len(body) <= 6000 else body[:6000] + "…")


def test_titles_take_the_first_prompts(spark):
    rows = [(1, 1, "human", "Hello"), (1, 2, "agent", "hi"), (1, 3, "human", "fix the build"), (1, 4, "human", "more"), (2, 1, "agent", "no prompt here"), (3, 1, "human", " "), (3, 2, "human", "second line")]
    got = {r["conv_id"]: r["title"] for r in chunking.titles(spark.createDataFrame(rows, "conv_id long, seq int, role string, text string")).collect()}
    assert got == {1: "Hello → fix the build", 2: "2", 3: "second line"}


def test_around_and_tail(spark):
    assert [r["seq"] for r in chunking.around(turns(spark, 20), 10, 2).orderBy("seq").collect()] == [8, 9, 10, 11, 12]
    assert [r["seq"] for r in chunking.tail(turns(spark, 5), 2).orderBy("seq").collect()] == [4, 5]
    with pytest.raises(ValueError):
        chunking.around(turns(spark, 2), 1, -1)


def brute_rrf(lists, k=60):
    scores = {}
    for ranked in lists:
        for i, key in enumerate(ranked, 1):
            scores[key] = scores.get(key, 0) + 1 / (k + i)
    return sorted(scores, key=lambda x: -round(scores[x], 12)), scores


def test_rrf(spark):
    rng = random.Random(1)
    for _ in range(3):
        lists = [rng.sample(range(20), rng.randint(1, 15)) for _ in range(3)]
        order, scores = brute_rrf(lists)
        frames = [spark.createDataFrame([(key, i) for i, key in enumerate(x, 1)], "id long, rank int") for x in lists]
        rows = fusion.fused_rank(fusion.rrf(frames)).orderBy("fused_rank").collect()
        assert [r["id"] for r in rows] == order
        assert all(abs(r["rrf"] - scores[r["id"]]) < 1e-12 for r in rows)


def test_collapse(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(6), rng.choice(["window", "session"]), 1 / (i + 1), 0, i + 1) for i in range(40)]
    want = {}
    for key, conv, kind, score, _, _ in rows:
        best = want.setdefault(conv, [key, score, len(want) + 1, kind])
        if kind == "window" and best[3] != "window":
            best[0], best[3] = key, kind
    fused = spark.createDataFrame(rows, "id long, conv_id long, granularity string, rrf double, list_no int, list_rank int")
    got = fusion.collapse(fused, "conv_id", F.col("granularity"), limit=99).collect()
    assert {r["conv_id"]: (r["id"], r["score"], r["place"]) for r in got} == {c: tuple(v[:3]) for c, v in want.items()}


def test_global_rank(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(7)) for i in range(500)]
    ranked = fusion.global_rank(spark.createDataFrame(rows, "id int, score int").repartition(5), F.desc("score"), F.asc("id"))
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [(r["id"], r["rank"]) for r in ranked.orderBy("rank").collect()] == [(i, k) for k, (i, _) in enumerate(order, 1)]


def test_lexical_search_does_not_read_vectors(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "window", "hello world", [0.1, 0.2])], "id string, conv_id long, granularity string, content string, embedding array<float>")
    df.write.parquet(f"{tmp_path}/items")
    hits = retrieval.hybrid_rank(spark.read.parquet(f"{tmp_path}/items"), "hello", None)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan and hits.count() == 1


def test_cjk_channel(spark):
    df = spark.createDataFrame([("a", 1, "window", "搜索 记忆", "搜索 记忆"), ("b", 2, "window", "plain words", None)], "id string, conv_id long, granularity string, content string, content_cjk string")
    assert [r["id"] for r in retrieval.channel_search(df, "记忆", None).collect()] == ["a"]


def test_diff_and_apply(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "k int, content_sha256 string")
    old = spark.createDataFrame([(1, "a", True), (2, "x", True), (3, "c", False), (9, "z", True)], "k int, content_sha256 string, has_vector boolean")
    got = {r["k"]: r["action"] for r in merging.diff_by_key(new, old, ["k"], has_vector="has_vector").collect()}
    assert got == {1: "unchanged", 2: "update", 3: "embed", 4: "insert", 9: "delete"}
    stored = old.withColumn("created_at", F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")).withColumn("updated_at", F.col("created_at"))
    rows = {r["k"]: r for r in merging.apply_diff(new, stored, ["k"], now=at()).collect()}
    assert sorted(rows) == [1, 2, 3, 4] and rows[2]["created_at"] == datetime(2025, 1, 1) and rows[2]["updated_at"] == datetime(2026, 1, 10) and rows[1]["updated_at"] == datetime(2025, 1, 1)


def test_scd2_twice_is_once(spark):
    schema = "k int, content_hash string, valid_from timestamp_ntz, superseded_at timestamp_ntz"
    history = spark.createDataFrame([(1, "a", datetime(2025, 1, 1), None), (2, "b", datetime(2025, 1, 1), None)], schema)
    targets = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "k int, content_hash string")
    once = merging.scd2_merge(history, targets, "k", at())
    twice = merging.scd2_merge(once, targets, "k", at())
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, twice.collect()), key=repr)
    assert {(r["k"], r["content_hash"]) for r in once.filter("superseded_at is null").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, h string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "id int, h string")
    c = spark.createDataFrame([(2, "y"), (1, "z")], "id int, h string")
    first = lambda d: merging.fingerprint(d, "id", "h").first()
    assert first(a) == first(b) != first(c)


def test_host_switch(spark):
    df = spark.createDataFrame([(True, "a"), (False, "b"), (False, "me"), (False, None)], "live boolean, host string")
    assert [r["s"] for r in df.select(sessions.host_switch(F.col("live"), F.col("host"), F.lit("me")).alias("s")).collect()] == ["contention", "handoff", "none", "none"]


def test_lineage_of_a_long_chain(spark):
    spark.createDataFrame([(i, i - 1 if i else -5) for i in range(150)], "session_id long, parent_session_id long").createOrReplaceTempView("long_sessions")
    assert [(r["depth"], r["session_id"]) for r in graph.lineage(spark, "long_sessions", 149).orderBy("depth").collect()] == [(k, 149 - k) for k in range(150)]
    assert graph.lineage(spark, "long_sessions", 500).collect() == []


def test_lineage_survives_a_loop(spark):
    spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 2), (5, 99)], "session_id int, parent_session_id int").createOrReplaceTempView("loop_sessions")
    assert [r["session_id"] for r in graph.lineage(spark, "loop_sessions", 4).orderBy("depth").collect()] == [4, 2, 1, 3]
    got = {r["session_id"]: (r["root"], r["depth"]) for r in graph.ancestors(spark.table("loop_sessions"), rounds=6).collect()}
    assert got[5] == (5, 0) and got[1] == (None, None)


def test_decisions(spark):
    rows = [(1, datetime(2026, 1, 1), ["use a"], []), (2, datetime(2026, 1, 2), ["use b"], [1]), (3, datetime(2026, 1, 3), [], [1])]
    df = spark.createDataFrame(rows, "checkpoint_id long, created_at timestamp_ntz, decisions array<string>, supersedes array<long>")
    assert {(r["decision"], r["superseded_by"]) for r in sessions.decisions(df).collect()} == {("use a", 3), ("use b", None)}


def test_fresh_items(spark):
    df = spark.createDataFrame([("qc_passed", "h", "h"), ("qc_passed", "h", "x"), ("running", "h", "h"), ("completed", None, "h")], "s string, a string, b string")
    assert [r["f"] for r in df.select(jobs.is_fresh(F.col("s"), F.col("a"), F.col("b")).alias("f")).collect()] == [True, False, False, False]


def test_greedy_batches(spark):
    rng = random.Random(3)
    groups = [[rng.randint(0, 12) for _ in range(rng.randint(1, 15))] for _ in range(20)] + [[rng.randint(0, 4) for _ in range(25_000)]]
    want = {}
    for g, sizes in enumerate(groups):
        held, no = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > 10:
                no, held = no + 1, 0
            want[g, i] = no
            held += n
    df = spark.createDataFrame([(g, i, "x" * n) for g, sizes in enumerate(groups) for i, n in enumerate(sizes)], "g long, i int, t string")
    assert {(r["g"], r["i"]): r["batch"] for r in batching.batched(df, "g", "i", "t", 10).collect()} == want


def test_greedy_batches_null_and_order(spark):
    df = spark.createDataFrame([(None, 2, "aaaa"), (None, 1, "bbb"), (1, 1, None), (1, 2, "cccccc"), (1, 3, "")], "g long, i int, t string")
    got = batching.batched(df, "g", "i", "t", 5).collect()
    assert {(r["g"], r["i"], r["t"], r["batch"]) for r in got} == {(None, 1, "bbb", 0), (None, 2, "aaaa", 1), (1, 1, None, 0), (1, 2, "cccccc", 0), (1, 3, "", 1)}


def plain_pieces(text, most):
    out, held = [], ""
    for line in text.split("\n"):
        line += "\n"
        if held and len(held) + len(line) > most:
            out.append(held)
            held = ""
        while len(line) > most:
            out.append(line[:most])
            line = line[most:]
        held += line
    return [*out, held]


@pytest.mark.parametrize("text", ["a\nb\n", "x" * 25, "line one\n" * 5, "ab\n" + "y" * 23 + "\nz", "\n" * 23, "\U0001f600" * 31, "123456789\n123456789\nz", "a\r\nb\u2028c" * 9])
def test_split_text(spark, text):
    parts = spark.createDataFrame([(text,)], "t string").select(batching.split_text(F.col("t"), 10).alias("p")).first()["p"]
    assert "".join(parts) == text and all(0 < len(p) <= 10 for p in parts)
    # The plain version ends every text with a line end.
    ended = spark.createDataFrame([(text + "\n",)], "t string").select(batching.split_text(F.col("t"), 10).alias("p")).first()["p"]
    assert ended == plain_pieces(text, 10)


def test_translate_rejoins_whole_turns(spark):
    pieces = batching.split_pieces(spark.createDataFrame([(1, 1, "word " * 60), (1, 2, "short"), (1, 3, "lost " * 60)], "conv_id long, seq int, text string"), 100)
    done = batching.translate(pieces, lambda d: {k: t.upper() for k, t in d.items() if k != "3#1"})
    assert {(r["seq"], r["text"]) for r in done.collect()} == {(1, "WORD " * 60), (2, "SHORT")}


def test_translate_keeps_conversations_apart(spark):
    turns_ = spark.createDataFrame([(c, 1, f"text of {c}") for c in range(5)], "conv_id long, seq int, text string").coalesce(1)
    done = batching.translate(batching.split_pieces(turns_), lambda d: {k: t.upper() for k, t in d.items()})
    assert {(r["conv_id"], r["text"]) for r in done.collect()} == {(c, f"TEXT OF {c}") for c in range(5)}


def test_embed_skips_blanks_and_failures(spark):
    def fn(texts):
        if "bad" in texts:
            raise ValueError("model")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, " "), (3, "bad"), (4, "zz")], "id long, text string").coalesce(1)
    assert {r["id"]: r["embedding"] for r in batching.embed(df, "id", "text", fn, most_items=1).collect()} == {1: [3.0], 2: None, 3: None, 4: [2.0]}
    told = {r["id"]: r["error"] for r in batching.embed(df, "id", "text", fn, most_items=1, report=True).collect()}
    assert told == {1: None, 2: None, 3: "ValueError: model", 4: None}


ANSWERS = [
    ('<think>x {</think>```json\n{"a": 1}\n```', {"a": "1"}), ('noise {"a": "b\\q"} tail', {"a": "b\\q"}), ('{"a": "open', {"a": "open"}), ("none", None), (None, None), ("", None), ("{}", {}),
    ('{"a": {"b": 2}', {"a": '{"b":2}'}), ('{"a": "two\nlines", "b": "\\u00e9"}', {"a": "two\nlines", "b": "é"}), ("} no object {", {}), ('[1] {"a": "}"} x', {"a": "}"}),
]


def test_repair_json(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ANSWERS)], "i int, t string")
    got = {r["i"]: r["m"] for r in df.select("i", batching.repair_json(F.col("t")).alias("m")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(ANSWERS)}


def test_integrity(spark):
    rows = [("root", "root", None, ["a", "zz"]), ("a", "t", "root", []), ("a", "t", "root", []), ("b", "t", "gone", []), ("c", "t", None, [])]
    df = spark.createDataFrame(rows, "id string, type string, parent string, children array<string>")
    assert {(r["finding"], r["id"]) for r in quality.integrity(df).collect()} == {("duplicate", "a"), ("parent_not_found", "b"), ("child_not_found", "root"), ("orphan", "c")}


def test_leaks(spark):
    lines = ["at 10.1.2.3", "me@example.com", 'token = "abcdefgh"', "sk-" + "a" * 20, "AKIA" + "A" * 16, "172.20.0.1", "172.40.0.1", "192.168.0.9", "fine"]
    df = spark.createDataFrame([("f", "\n".join(lines))], "path string, text string")
    found = quality.leak_scan(df, "path", "text", allow=("example.com",))
    assert {(r["line"], r["rule_id"]) for r in found.collect()} == {(1, "private-ip-10"), (2, "email"), (3, "assigned-secret"), (4, "openai-key"), (5, "aws-key"), (6, "private-ip-172"), (8, "private-ip-192")}
    assert found.filter("allowlisted").count() == 1 and quality.gate(found).first()["status"] == "FAIL"
    assert quality.leak_scan(df, "path", "text", disable=("email",), add=(("own", "warn", "fine"),)).filter("rule_id = 'own'").count() == 1


def test_schema(spark):
    files = spark.createDataFrame([("ok", '{"graphType":"skills","role":"role-x","generatedAt":"t","skills":[{"id":"a"}]}'), ("bad", '{"graphType":"x","role":"y","generatedAt":"t","skills":[{"id":""}]}'), ("no", "{")], "path string, value string")
    got = defaultdict(set)
    for r in quality.schema_findings(files, "skills").collect():
        got[r["path"]].add(r["finding"])
    assert "ok" not in got and got["bad"] == {"wrong graphType", "wrong role", "item without id"} and "not JSON" in got["no"]


def test_health(spark):
    assert quality.health(spark.createDataFrame([("PASS",), ("WARN",)], "status string")).first()["status"] == "WARN"
