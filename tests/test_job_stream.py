"""The job log as a stream against the whole log."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import jobs, sessions
from tessera.streaming import jobs as live_jobs
from tessera.streaming import live

SCHEMA = "run_id string, item string, event_id long, ts timestamp, status string, score double, error_text string, bump boolean"
START = datetime(2026, 1, 1)


def events(seed, n=60):
    """Events of three runs within half an hour, in an order of their own; many times are equal."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = START + timedelta(minutes=rng.randint(0, 12), microseconds=rng.choice([0, 1, 999_999]))
        out.append((f"r{i % 3}", f"i{rng.randint(0, 4)}", i, at, rng.choice([None, "running", "completed", "error"]), rng.choice([None, 0.5, 0.25]), rng.choice([None, "oops"]), rng.choice([True, False, None])))
    rng.shuffle(out)
    return out


def cut(rows, seed):
    rng, out = random.Random(seed), []
    while rows:
        n = rng.randint(1, 25)
        out.append(rows[:n])
        rows = rows[n:]
    return out


def run(spark, path, make, name, parts, stop_at=None):
    """Feed parts as files of one batch each; with `stop_at` the query ends there and starts again from its checkpoint."""
    far = [("last", "last", 10**6 + k, START + timedelta(days=2 + k), None, None, None, None) for k in range(2)]
    parts = [*parts, *([row] for row in far)]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = []

    def go(upto):
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{path}/log")
        q = make(stream).writeStream.foreachBatch(lambda df, k: rows.extend((k, r) for r in df.collect())).outputMode(name).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None

    try:
        for k, part in enumerate(parts):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{path}/log/{k:03d}")
            if stop_at is not None and k == stop_at:
                go(k)
        go(len(parts))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_numbers_of_any_cut(spark, tmp_path, seed):
    rows = events(seed)
    want = {(r["run_id"], r["event_id"]): r["seq"] for r in sessions.with_seq(spark.createDataFrame(rows, SCHEMA)).collect()}
    got = run(spark, tmp_path, lambda s: live_jobs.numbered(s), "append", cut(rows, seed), stop_at=1 if seed == 2 else None)
    assert {(r["run_id"], r["event_id"]): r["seq"] for _, r in got if r["run_id"] != "last"} == want
    assert len([r for _, r in got if r["run_id"] != "last"]) == len(rows)  # each once, also over a restart


def test_numbers_go_on_from_what_is_stored(spark, tmp_path):
    rows = [r for r in events(3, 12)]
    stored = spark.createDataFrame([("r0", 7)], "run_id string, seq long")
    got = run(spark, tmp_path, lambda s: live_jobs.numbered(s, stored=stored), "append", [rows])
    numbers = {name: sorted(r["seq"] for _, r in got if r["run_id"] == name) for name in ("r0", "r1")}
    assert numbers == {"r0": [8, 9, 10, 11], "r1": [1, 2, 3, 4]}


@pytest.mark.parametrize("seed", [4, 5])
def test_items_of_any_cut(spark, tmp_path, seed):
    rows = events(seed)
    order = {r[2]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[3], r[2])))}
    log = spark.createDataFrame([(*r, order[r[2]]) for r in rows], SCHEMA + ", seq long")
    want = {r["item"]: (r["status"], r["score"], r["error_text"], r["attempt"] or 0) for r in jobs.fold_items(log).collect()}
    got = run(spark, tmp_path, lambda s: live_jobs.folded(s), "update", cut(rows, seed), stop_at=1 if seed == 5 else None)
    last = {}
    for k, r in sorted(got, key=lambda x: x[0]):
        last[r["item"]] = (r["status"], r["score"], r["error_text"], r["attempt"])
    last.pop("last", None)
    assert last == want


def test_late_status_changes_nothing(spark, tmp_path):
    schema = "item long, ts timestamp, status string, bump boolean"
    for k, (hour, status) in enumerate([(2, "done"), (1, "running")]):
        spark.createDataFrame([(1, START + timedelta(hours=hour), status, True)], schema).coalesce(1).write.parquet(f"{tmp_path}/log/{k}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    q = live.fold_job_log(stream).writeStream.outputMode("update").format("memory").queryName("late_log").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("late_log").groupBy("item").agg(F.max_by(F.struct("status", "attempt", "seq"), "seq").alias("s")).select("s.*").collect()
    assert [tuple(r) for r in last] == [("done", 2, 2)]
