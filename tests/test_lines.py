"""The data source of transcript lines."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import lines, transcripts


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    for name in ("a-repo", "repo", "other"):
        os.makedirs(f"{tmp_path}/{name}")
        for k in range(2):
            rows = []
            for i in range(60):
                text = rng.choice(["plain", "Größe 会議 \U0001f600", "", "x" * rng.randint(0, 300)])
                rows.append(rng.choice([{"role": "user", "message": {"content": [{"type": "text", "text": f"{i} {text}"}]}}, {"type": "assistant", "role": "assistant", "message": {"content": [{"type": "tool_use", "name": "T", "input": {"n": i}}]}}, {"type": "ai-title", "aiTitle": f"t{i}"}]))
            raw = "\n".join(json.dumps(r, ensure_ascii=False) for r in rows)
            with open(f"{tmp_path}/{name}/{k}.jsonl", "w", encoding="utf-8", newline="") as f:
                f.write(raw.replace("\n", "\n\n", 3) + rng.choice(["", "\n", "\nnot json\n"]))
    with open(f"{tmp_path}/repo/notes.txt", "w") as f:
        f.write("no transcript")
    return str(tmp_path)


def bare(path):
    return path.removeprefix("file://").removeprefix("file:")


@pytest.mark.parametrize("split", [37, 1000, 64 << 20])
def test_ranges_give_every_line_once(spark, folder, split):
    got = lines.lines(spark, folder, split_bytes=split).collect()
    want = {}
    for d, _, names in os.walk(folder):
        for n in names:
            if n.endswith(".jsonl"):
                at, data = 0, open(f"{d}/{n}", "rb").read()
                for line in data.split(b"\n"):
                    if line:
                        want[f"{d}/{n}", at] = line.decode()
                    at += len(line) + 1
    assert len(got) == len(want) and {(bare(r["path"]), r["offset"]): r["raw"] for r in got} == want


@pytest.mark.parametrize("split", [100, 5000])
@pytest.mark.parametrize("reader", ["nested", "typed"])
def test_turns_are_those_of_whole_files(spark, folder, reader, split):
    found = lines.lines(spark, folder, split_bytes=split)
    assert found.rdd.getNumPartitions() > 6
    plain = lambda df: sorted((bare(r["path"]), r["seq"], r["role"], r["text"], str(r["tools"])) for r in df.collect())
    got = plain(transcripts.READERS[reader](found))
    assert got and got == plain(transcripts.READERS[reader](transcripts.files(spark, folder)))
    hints = lambda df: {bare(r["path"]): r["title_hint"] for r in transcripts.title_hints(df).collect()}
    assert hints(found) == hints(transcripts.files(spark, folder))


def test_other_checkouts_are_left_out(spark, folder):
    found = lines.lines(spark, folder, split_bytes=100)
    own = lines.lines(spark, folder, split_bytes=100, slug="repo")
    assert own.rdd.getNumPartitions() < found.rdd.getNumPartitions()
    names = {r["path"] for r in transcripts.discovered(transcripts.files(spark, folder), "repo").collect()}
    assert {bare(r["path"]) for r in own.select("path").distinct().collect()} == set(map(bare, names)) and len(names) == 4
    n = found.count()
    assert found.filter("folder = 'repo'").count() < n == found.count()
    assert lines.lines(spark, folder, slug="none").count() == 0


def test_files_that_cannot_be_read(spark, tmp_path):
    os.makedirs(f"{tmp_path}/d")
    with open(f"{tmp_path}/d/good.jsonl", "w") as f:
        f.write('{"role": "user", "message": {"content": [{"type": "text", "text": "x"}]}}\n')
    found = lines.lines(spark, str(tmp_path))
    reader = lines.LineReader({"path": str(tmp_path)})
    part = reader.partitions()[0]
    os.remove(f"{tmp_path}/d/good.jsonl")
    (batch,) = reader.read(part)
    assert batch.to_pylist()[0]["raw"] is None and "good.jsonl" in batch.to_pylist()[0]["error"]
    assert found.count() == 0 and transcripts.read_nested(found).count() == 0
