"""Operators against plain versions on small tables."""

from __future__ import annotations

import gzip
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, components, decontamination, hilbert_shards, jaccard_join, language_id, line_dedup, packing, quality_rules, queries, token_binary, toxicity, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


# --- tokens -----------------------------------------------------------------------------------


def test_run_encoder_gives_the_ids_of_whole_texts():
    rng, tok = random.Random(5), encoder()
    bits = ["word", "Word's", "don't", "x.", "a,b", "é", "é.", "́.", "1234", "  ", "\n", "\t", " ", " ", "\x1c", "\x01", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "ΣΑΣ", "İ", "ß", "日本", "\U0001f600", "...", "?!", "'s", "'LL"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    got, offsets = bpe.RunEncoder(queries.tokenizer_path())(pa.array(texts), 7)
    for i, t in enumerate(texts):
        assert got[offsets[i] : offsets[i + 1]].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 7], t


def test_run_encoder_composes_before_it_folds():
    """A small letter composes with these marks, the capital doesn't; other runs of the batch are folded."""
    pairs = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a"]
    texts = [*pairs, *(f"Word {p}.Word, aB{p}Cd Word" for p in pairs), "Word WORD word", "\u00dcBER Gr\u00f6\u00dfe"]
    tok = encoder()
    for batch in (texts, [*texts, "<|"], *([t] for t in texts)):
        got, offsets = bpe.RunEncoder(queries.tokenizer_path())(pa.array(batch), 7)
        for i, t in enumerate(batch):
            assert got[offsets[i] : offsets[i + 1]].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 7], t


def test_dac_round_trip():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 1 << k, 700, dtype=np.uint32) for k in (3, 8, 9, 16, 17, 31)])
    rng.shuffle(ids)
    offsets = np.sort(np.concatenate([[0, len(ids)], rng.integers(0, len(ids), 20)]))
    named = np.arange(len(offsets) - 1) % 3 > 0
    seg = token_binary.DacReader.of(token_binary.dac_encode(ids, offsets, -np.arange(len(offsets) - 1), named))
    assert [seg.token(i) for i in range(len(ids))] == ids.tolist()
    for b, e in zip(offsets, offsets[1:], strict=False):
        assert seg.tokens(int(b), int(e)).tolist() == ids[b:e].tolist()
    names, where = seg.documents()
    assert names.to_pylist() == [-i if named[i] else None for i in range(len(named))] and where.tolist() == offsets.tolist()
    assert token_binary.DacReader.of(token_binary.dac_encode(ids[:0], np.zeros(1, int), [], np.zeros(0, bool))).n_tokens == 0


def test_token_reads_few_bytes():
    """A token is read from its file by a few short reads, whatever the segment's size."""
    ids = np.random.default_rng(2).integers(0, 49_000, 200_000, dtype=np.uint32)
    image = token_binary.dac_encode(ids, np.array([0, len(ids)]), np.array([1]), np.array([True]))
    took = []
    seg = token_binary.DacReader(lambda at, n: took.append(n) or image[at : at + n])
    took.clear()
    assert seg.token(123_456) == ids[123_456] and sum(took) < 200


def test_op3_odd_ids(spark):
    """Negative, missing and repeated ids: missing ones come first, equal ones stay apart."""
    tok = encoder()
    rows = [(-5, "five below"), (None, "no id"), (None, None), (-1, "one below"), (3, "twice"), (3, "twice"), (3, "another")]
    got = token_binary.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer_path()).collect()
    crc = lambda t: zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids_crc32"]) for r in got) == sorted((i is not None, i or 0, crc(t)) for i, t in rows)
    start, last = 0, -100
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start and (-100 if r["doc_id"] is None else r["doc_id"]) >= last
        start, last = start + r["n_tokens"], -100 if r["doc_id"] is None else r["doc_id"]


def test_op3(spark):
    tok, start, want = encoder(), 0, {}
    for r in sorted(documents(spark).collect(), key=lambda r: r["doc_id"]):
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op3_token_binary(spark, SF).collect()} == want


def test_token_at(spark, tmp_path):
    tok, docs = encoder(), documents(spark).filter("doc_id < 20")
    token_binary.write_corpus(docs, path := f"file://{tmp_path}/corpus", queries.tokenizer_path(), 1, tokens_per_segment=500)
    ids = [i for r in docs.orderBy("doc_id").collect() for i in [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]]
    for k in (0, 1, 499, 777, len(ids) - 1):
        assert token_binary.token_at(spark, path, k) == ids[k]
    with pytest.raises(IndexError):
        token_binary.token_at(spark, path, len(ids))


def test_op5(spark):
    tok = encoder()
    ids = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in documents(spark).collect()}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in queries.op5_packing(spark, SF).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for group in (*windows.values(), *pieces.values()):
        at = 0
        for begin, n in sorted(group):
            assert begin == at
            at += n
    assert {k: sum(n for _, n in v) for k, v in pieces.items()} == {k: len(v) for k, v in ids.items()}
    assert max(sum(n for _, n in v) for v in windows.values()) <= 4096
    assert len(windows) <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_op5_rows_that_repeat(spark):
    """Rows alike in everything fill many cells, and each lies in one window."""
    pieces = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(1000).cast("long").alias("length"), F.lit(9).cast("long").alias("ids_crc32"), F.lit(1000).cast("long").alias("doc_tokens"))
    windows = defaultdict(list)
    for r in packing.pack(pieces, pieces_per_cell=100).collect():
        windows[r["sequence_id"]].append(r["offset"])
    assert sum(map(len, windows.values())) == 3000 and all(sorted(w) == [1000 * k for k in range(len(w))] for w in windows.values())
    assert len({w >> 32 for w in windows}) > 20 and len(windows) <= 750 + 31


def test_closest_subset_is_exact():
    rng = random.Random(2)
    for _ in range(200):
        lengths = sorted(rng.sample(range(1, 30), 5), reverse=True)
        counts, room = [rng.randint(1, 4) for _ in lengths], rng.randint(0, 60)
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        used = packing.closest_subset(lengths, counts, room)
        assert all(u <= c for u, c in zip(used, counts, strict=True))
        assert sum(u * n for u, n in zip(used, lengths, strict=True)) == max(s for s in sums if s <= room)


# --- near duplicates --------------------------------------------------------------------------


def shingles(text, n=5):
    words = WORD.findall(fold(text or ""))
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def brute_links(rows):
    sets = {i: shingles(t) for i, t in rows}
    links = defaultdict(set)
    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    return links


def classes(keys, links):
    out = {}
    for k in sorted(keys):
        if k not in out:
            todo = [k]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = k
                    todo += links[x]
    return out


def near_corpus():
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(80)) for _ in range(12)]
    texts = []
    for b in base:
        words = b.split()
        for k in range(rng.randint(1, 9)):
            w = list(words)
            for _ in range(k % 4):
                w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
            texts.append(" ".join(w))
    return list(enumerate([*texts, "short one", "Short, one", "", None]))


@pytest.mark.parametrize("block,shingles", [(1000, 1 << 20), (3, 1 << 20), (1000, 200)])
def test_op1(spark, block, shingles):
    rows = near_corpus()
    links = brute_links(rows)
    want = classes([i for i, _ in rows], links)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block, block_shingles=shingles).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {i: (want[i], len(links[i])) for i, _ in rows}


def brute_rows(rows):
    """For each row: the rows linked to it, and the least id that it reaches."""
    links = brute_links(list(enumerate(t for _, t in rows)))
    links = {k: v for k, v in links.items()}
    alone = {k for k, (i, t) in enumerate(rows) if i is None or not shingles(t)}
    links = defaultdict(set, {k: {x for x in v if x not in alone} for k, v in links.items() if k not in alone})
    group = classes(range(len(rows)), links)
    least = {}
    for k, g in group.items():
        least[g] = min((rows[k][0] for k in group if group[k] == g and rows[k][0] is not None), default=None)
    return links, group, {k: least[g] for k, g in group.items()}


def test_op1_repeated_rows_and_ids(spark):
    """Rows that repeat, ids with several texts, and texts with several ids; by value, row by row."""
    base = [t for _, t in near_corpus()]
    rows = [(i, t) for i, t in enumerate(base)] + [(3, base[3])] * 3 + [(5, base[40 % len(base)]), (7, base[0]), (2, "a text of its own under an id that another text has"), (None, base[0]), (1, None), (1, None)]
    links, group, least = brute_rows(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(docs, block=4).collect())
    assert got == Counter((i, least[k], len(links[k])) for k, (i, _) in enumerate(rows))
    kept = Counter(map(tuple, jaccard_join.keep_one(docs, block=4).collect()))
    grouped = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        grouped[group[k]].append((i, t))
    # One row of each group's smallest id; rows without words or an id all stay.
    assert sum(kept.values()) == len(grouped)
    for own in grouped.values():
        ids = [i for i, _ in own if i is not None]
        assert sum(kept[x] for x in set(own) if not ids or x[0] == min(ids)) >= 1


def test_op1_chain(spark):
    """A chain of groups, each near the next: units are cut by star, no link is lost."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(10_000)}" for _ in range(60)]
    rows = []
    for i in range(60):
        words = [*words[3:], *(f"w{rng.randrange(10_000)}" for _ in range(3))]
        rows.append((i, " ".join(words)))
    links = brute_links(rows)
    want = classes([i for i, _ in rows], links)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=5).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {i: (want[i], len(links[i])) for i, _ in rows}


def test_op1_on_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    links = brute_links(rows)
    want = classes([i for i, _ in rows], links)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in queries.op1_jaccard_join(spark, SF).collect()} == {i: (want[i], len(links[i])) for i, _ in rows}


@pytest.mark.parametrize("recall", [0.5, 0.9, 0.99, 0.9999, 0.999999])
def test_bands_reach_the_recall(recall):
    for threshold in (0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 1.0):
        b, r = jaccard_join.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**r) ** b >= recall
        assert r == 1 or b <= 25
    for threshold, r in ((0.0, 0.9), (-0.1, 0.9), (1.1, 0.9), (0.8, 1.0)):
        with pytest.raises(ValueError):
            jaccard_join.choose_bands(threshold, r)


@pytest.mark.parametrize("threshold", [0.1, 0.3])
def test_op1_low_thresholds(spark, threshold):
    """Texts of 12 words out of 15, so that most pairs are links at these thresholds."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefghijklmno") for _ in range(12))) for i in range(40)]
    sets = {i: {tuple(t.split()[k : k + 1]) for k in range(12)} for i, t in rows}
    want = {i: sum(j != i and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) for j in sets) for i in sets}
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold, n=1).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == want and sum(want.values()) > 400


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    links = defaultdict(set)
    for u, v in edges:
        links[u].add(v)
        links[v].add(u)
    want = {k: c for k, c in classes(links, links).items() if links[k] - {k}}
    got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == want


# --- language, quality, lines -----------------------------------------------------------------


def test_op2_on_held_out_documents(spark):
    got = queries.op2_language_id(spark, SF).join(documents(spark), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_op2_without_letters(spark):
    docs = documents(spark)
    p = language_id.train(docs, dims=128)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "\U0001f600")], "doc_id long, text string")
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(odd, p).collect()} == {("und", 0.0)}


def plain_vector(p, text):
    """The sum of the n-grams' vectors, letter by letter."""
    line = " " + re.sub(" +", " ", "".join(c.lower() if c.isalpha() else " " for c in text))
    item = {c: p.letter_vectors(np.array([0 if c == " " else ord(c)]))[0].astype(int) for c in set(line)}
    total = np.zeros(p.dims, int)
    for i in range(len(line) - p.gram + 1):
        if line[i : i + p.gram].endswith("  "):
            continue
        total += np.prod([np.roll(item[line[i + k]], p.gram - 1 - k) for k in range(p.gram)], axis=0)
    return total / np.linalg.norm(total)


def test_op2_vectors():
    rng = random.Random(12)
    letters = [chr(c) for c in (*range(97, 123), *range(0x430, 0x450), *range(0x3B1, 0x3C9), *range(0x4E00, 0x5200), *range(0x20000, 0x20040))]
    few = [" ".join("".join(rng.choice(letters[:8]) for _ in range(4)) for _ in range(30)) for _ in range(20)]
    many = ["".join(rng.choice([*letters, " ", ", "]) for _ in range(200)) for _ in range(40)]
    for texts in (few, many, few + many):
        for p in (language_id.Profiles([], np.zeros((0, 96), np.float32), dims=96), language_id.Profiles([], np.zeros((0, 70), np.float32), gram=2, dims=70)):
            for cells in (2 << 20, 500):
                unit, has = p.vectors(pa.array(texts), cells)
                assert has.all() and np.allclose(unit, [plain_vector(p, t) for t in texts], atol=1e-5)


def test_op2_against_a_plain_loop(spark):
    """Training and prediction, text by text and letter by letter."""
    docs = documents(spark).filter("length(text) < 1500").limit(120)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    blank = language_id.Profiles([], np.zeros((0, 64), np.float32), dims=64)
    unit = {i: plain_vector(blank, t) for i, t, _ in rows if any(c.isalpha() for c in t)}
    sums = defaultdict(lambda: np.zeros(64))
    for i, _, lang in rows:
        if lang is not None and i in unit and zlib.crc32(str(i).encode()) % 4 != 2:
            sums[lang] += unit[i]
    langs = sorted(sums)
    got = {r["doc_id"]: r for r in language_id.identify(docs, language_id.train(docs, dims=64, texts_per_lang=10**6)).collect()}
    for i, v in unit.items():
        cosines = {k: v @ sums[k] / np.linalg.norm(sums[k]) for k in langs}
        best = max(cosines.values())
        assert abs(got[i]["score"] - max(best, 0)) < 1e-4 and cosines[got[i]["lang_pred"]] > best - 1e-4


def test_op2_with_many_letters(spark):
    """Pairs of languages that share a rare or large script, next to a Latin one with most of the letters' uses."""
    rng = random.Random(13)
    scripts = {"la": (0x61, 26, 900), "ru": (0x430, 32, 40), "uk": (0x430, 32, 40), "zh": (0x4E00, 3000, 40), "ja": (0x4E00, 3000, 40), "xa": (0x20000, 500, 40), "xb": (0x20000, 500, 40)}
    words = {k: ["".join(chr(a + rng.randrange(n)) for _ in range(rng.randint(2, 4))) for _ in range(200)] for k, (a, n, _) in scripts.items()}
    rows = [" ".join(rng.choice(words[k]) for _ in range(40)) for k, (_, _, m) in scripts.items() for _ in range(m)]
    langs = [k for k, (_, _, m) in scripts.items() for _ in range(m)]
    docs = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(zip(rows, langs, strict=True))], "doc_id long, text string, lang string")
    held = [(r["lang_pred"], langs[r["doc_id"]]) for r in language_id.identify(docs, language_id.train(docs, dims=512)).collect() if r["held_out"]]
    assert {k for _, k in held} == set(scripts) and sum(a == b for a, b in held) >= 0.98 * len(held)


def brute_quality(text):
    space = "\x20\x09\x0a\x0b\x0c\x0d"
    words = re.findall(rf"[^{space}]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += line in seen and line.strip(space) != ""
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated)


def test_op7(spark):
    want = {r["doc_id"]: brute_quality(r["text"]) for r in documents(spark).collect()}
    for r in queries.op7_quality_rules(spark, SF).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want[r["doc_id"]]
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_op7_lines(spark):
    """Bullets, ellipses and words with letters against plain loops; a rule fails only beyond its share."""
    space = "\x20\x09\x0a\x0b\x0c\x0d"
    rng = random.Random(5)
    bits = ["-", "*", "•", "...", "…", "..", "a", "12", "é", "word...", "-x", " ", "\t", "\n", "\n", "x…", "\r", "\x0b"]
    texts = ["", None, "\n", "...", "-", "•\n\n", "a…\r\n", *("".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(40))) for _ in range(300))]
    rows = quality_rules.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        each = [line.strip(space) for line in text.split("\n") if line.strip(space)]
        words = re.findall(rf"[^{space}]+", text)
        assert (r["n_worded_lines"], r["n_bullet_lines"]) == (len(each), sum(line[0] in "-*•" for line in each))
        assert r["n_ellipsis_lines"] == sum(line.endswith(("...", "…")) for line in each)
        assert r["n_letter_words"] == sum(any(c > "\x7f" or c.isalpha() for c in w) for w in words)
        assert bool(r["failed"] & quality_rules.BIT["few_letter_words"]) == (10 * r["n_letter_words"] < 8 * len(words))


def test_op7_ablations(spark):
    rows = quality_rules.ledger(documents(spark)).cache()
    masks, v1 = [r["failed"] for r in rows.collect()], quality_rules.POLICIES["v1"]
    for r in quality_rules.ablations(rows, "v1").collect():
        bit = quality_rules.BIT[r["rule"]]
        assert r["n_failed"] == sum(bool(m & bit) for m in masks) and r["n_won_back"] == sum(m & v1 == bit for m in masks)


def brute_lines(rows, most):
    space = "\x20\x09\x0a\x0b\x0c\x0d"
    key = lambda line: fold(line.strip(space))
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if key(line):
                docs[key(line)].add(i)
    return {i: [line for line in (t or "").split("\n") if len(docs[key(line)]) < most] for i, t in rows}


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (5, 3), (7, 9)])
def test_op4(spark, batches, fanout):
    rng = random.Random(6)
    bits = ["Same", " same\t", "SAME\x0b", "É", "é", "", " ", "other", "x", "\x1cx", "rare"]
    rows = [(i, "\n".join(rng.choice(bits[: rng.randint(1, len(bits))]) for _ in range(rng.randint(0, 6)))) for i in range(40)] + [(40, None), (41, "")]
    want = brute_lines(rows, 10)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), most=10, batches=batches, fanout=fanout).collect()
    for r in got:
        n = len((dict(rows)[r["doc"]["doc_id"]] or "").split("\n"))
        kept = want[r["doc"]["doc_id"]]
        assert (r["n_lines"], r["n_dropped"], r["kept_text"]) == (n, n - len(kept), "\n".join(kept))


def test_keep_first_over_batches(spark):
    runs, seen = line_dedup.LineRuns(spark, most=10**9, fanout=2), set()
    rng = random.Random(7)
    for _ in range(5):
        batch = {(rng.randrange(30), 0) for _ in range(12)}
        keys = spark.createDataFrame([(*k, 1) for k in batch], "h1 long, h2 long, n_docs long")
        assert {(r["h1"], r["h2"]) for r in runs.unseen(keys).collect()} == batch - seen
        runs.add(keys)
        seen |= batch


# --- decontamination, archives, toxicity, shards ------------------------------------------------


def brute_hits(docs, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        words = WORD.findall(fold(text or "")) if item is not None else []
        for i in range(max(len(words) - width + 1, 1) if words else 0):
            windows[tuple(words[i : i + width])].add(str(item))
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        words = WORD.findall(fold(text or ""))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if own := windows.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out[doc] = (len(words), len(hit), sorted(found))
    return out


def rows_of(df):
    return {r["doc_id"]: (r["n_words"], sum(s["last"] - s["first"] for s in r["spans"]), list(r["items"])) for r in df.collect()}


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_op8(spark, block_bytes):
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "b", "c", "É", "é9", "Z"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(30)] + [(30, None)]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 300)))) for i in range(30)]
    docs += [(40 + i, f"q {items[i][1]}-{items[(i + 1) % 30][1]} q") for i in range(30)] + [(90, None), (91, docs[3][1])]
    got = decontamination.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert rows_of(got) == brute_hits(docs, items)


def test_op8_on_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_hits(docs, items)
    for r in queries.op8_decontamination(spark, SF).collect():
        n, hit, found = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0)


def test_op8_cuts_spans(spark):
    """Cut texts hold no window, also where a cut joins words to one; the rest of each text stays."""
    rng = random.Random(10)
    passage = " ".join(f"p{i}" for i in range(12))
    items = spark.createDataFrame([("a", passage), ("b", "short one")], "item_id string, text string")
    filler = lambda: " ".join(f"f{rng.randrange(50)}" for _ in range(30))
    nested = " ".join(f"p{i}" for i in range(6)) + " short one " + " ".join(f"p{i}" for i in range(6, 12))
    rows = [(1, f"{filler()}. {passage.upper()}! {filler()}"), (2, filler()), (3, None), (4, passage), (5, f"x {nested} y"), (6, f"é {passage} é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in decontamination.cut_contaminated(docs, items).collect()}
    assert out[2] == rows[1][1] and out[3] is None and out[4] == "" and out[6] == "é  é"
    assert out[1] == rows[0][1].replace(passage.upper(), "") and out[5].split() == ["x", "y"]
    assert not any(r["items"] for r in decontamination.search(spark.createDataFrame(list(out.items()), "doc_id long, text string"), items).collect())


def test_op8_long_text(spark):
    """A text over the size of a slice is a shard of its own."""
    passage = " ".join(f"p{i}" for i in range(12))
    text = "word " * 900_000 + passage + " word" * 900_000
    got = decontamination.search(spark.createDataFrame([(1, text), (2, passage)], "doc_id long, text string"), spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert rows_of(got) == {1: (1_800_012, 12, ["1"]), 2: (12, 12, ["1"])}


def test_fm_index():
    rng = np.random.default_rng(9)
    text = np.where(rng.random(3000) < 0.05, 0, rng.integers(1, 5, 3000))
    text[-1] = 0
    index = decontamination.FMIndex(text, 4)
    for n in (1, 2, 5, 8):
        phrases = rng.integers(1, 5, (40, n))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high, strict=True):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


def test_op6_joins_alike(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select(F.pmod("page_id", F.lit(40)).alias("page_id"), "url", F.substring("html", 1, 17).alias("html"))
    few, many = (sorted(map(tuple, warc.with_originals(pages, broadcast_rows=n).collect()), key=repr) for n in (10**6, -1))
    assert few == many and any(r[3] is not None for r in few)


def test_op6(spark):
    rows = [(5, "http://a", "x"), (3, "http://b\r\nX: y", "x"), (9, None, None), (1, "http://c", ""), (2, "u", "é"), (7, "u", "x"), (4, "u", "only")]
    got = {r["page_id"]: r for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    least = defaultdict(lambda: 99)
    for i, _, h in rows:
        least[h or ""] = min(least[h or ""], i)
    for i, _, h in rows:
        body, first = (h or "").encode(), least[h or ""]
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), warc.digest_of(body))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == first else ("revisit", first))


def test_op6_odd_ids(spark):
    """A page -1 and a page without an id: the first is the response, the other revisits it."""
    rows = [(-1, "u", "same"), (None, "u", "same"), (None, "u", "alone"), (4, "u", "x"), (4, "u", "x"), (6, "u", "x")]
    got = Counter(tuple(r)[0:1] + tuple(r)[3:] for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == Counter([(-1, "response", None), (None, "revisit", -1), (None, "response", None), (4, "response", None), (4, "response", None), (6, "revisit", 4)])


def test_normaliser(spark, tmp_path):
    """Real files: one stream in, a member a record out, and an index that finds each member."""
    records = [warc.record_bytes(i, f"http://x/{i}", b"payload %d " % i * (1 if i % 5 else 200_000), None) for i in range(20)]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(records[:12])) + gzip.compress(b"".join(records[12:])))
    source = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "archive string")
    out = warc.normalise(source, f"file://{tmp_path}/out").first()
    path = out["archive"].removeprefix("file:")
    assert path.endswith(".warc.gz") and gzip.open(path).read() == b"".join(records)
    entries = [json.loads(x) for x in open(out["index"].removeprefix("file:"))]
    whole = open(path, "rb").read()
    for i, (record, e) in enumerate(zip(records, entries, strict=True)):
        assert gzip.decompress(whole[e["offset"] : e["offset"] + e["length"]]) == record and e["target"] == f"http://x/{i}"
        assert warc.record_at(out["archive"], e["offset"], e["length"])[0]["warc-type"] == "response"
    with pytest.raises(ValueError):
        warc.inflate(gzip.compress(b"x" * 100)[:-3])
    with pytest.raises(ValueError):
        list(warc.records_of(iter([gzip.compress(records[1][:-9])])))


def test_op9_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 3 > 0"))
    assert (np.diff(model.thresholds) > 0).all()
    held = docs.join(labels.filter("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    rated = toxicity.rate(held, model).join(held.select("doc_id", "label"), "doc_id").collect()
    clean = [r for r in rated if not r["label"]]
    toxic = [r for r in rated if r["label"]]
    assert sum(r["toxic"] for r in clean) <= 0.01 * len(clean)
    assert sum(r["toxic"] for r in toxic) >= 0.85 * len(toxic)  # about a tenth of the labels has no sign in the text
    assert np.mean([r["severity"] for r in toxic]) > 5 * np.mean([r["severity"] for r in clean])
    assert all(0 <= r["severity"] <= 3 and r["toxic"] == (r["grade"] > 0) for r in rated)


@pytest.mark.parametrize("sf,recall", [("sf0.001", 0.3), ("sf0.01", 0.6)])
def test_op9_on_few_labels(spark, sf, recall):
    """Trained on 11 and 51 toxic labels, rated on texts that training didn't see; the stage rejects rows."""
    small, large = f"/root/testdata/{sf}", "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.train(docs, labels)
    truth = spark.read.parquet(f"{large}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    held = spark.read.parquet(f"{large}/documents.parquet").join(truth, "doc_id").join(docs.select("text"), "text", "left_anti")
    rated = toxicity.rate(held, model).join(held.select("doc_id", "label"), "doc_id").collect()
    clean = [r["toxic"] for r in rated if not r["label"]]
    toxic = [r["toxic"] for r in rated if r["label"]]
    assert sum(toxic) >= recall * len(toxic) and sum(clean) <= 0.01 * len(clean)
    assert 0 < corpus_pipeline.remove_toxic(spark, docs, small).count() < docs.count()


def plain_features(word):
    """The hashed features of a word, byte by byte."""
    mask, mult = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def bucket(x, kind):
        x = (x + kind) * mult & mask
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & mask
        return ((x ^ x >> 32) * mult & mask) >> 44

    data = [b + 1 for b in word.encode()]
    out = [bucket(sum(b * pow(mult, i, 1 << 64) for i, b in enumerate(data)) & mask, 1)]
    for k in (4, 5):
        for i in range(len(data) - k + 1):
            value = 0
            for b in data[i : i + k]:
                value = value * 257 + b & mask
            out += [bucket(value, 2 * k)] + ([bucket(value, 2 * k + 1)] if i == 0 else [])
    return out


def test_op9_scores_against_a_plain_loop():
    rng = random.Random(14)
    texts = [r for r in ("Some people are fine, some PEOPLE are not", "ab", "", None, "Größe größe überall", "fools fooled foolish") if True]
    feats = sorted({f for t in texts for w in set(WORD.findall(fold(t or ""))) for f in plain_features(w)})
    weights = {f: rng.gauss(0, 1) for f in feats if rng.random() < 0.7}
    model = toxicity.OrdinalModel(np.array(list(weights)), np.array(list(weights.values())), np.array([0.5, 1.0, 2.5]))
    want = [sum(weights.get(f, 0) for w in set(WORD.findall(fold(t or ""))) for f in plain_features(w)) for t in texts]
    assert np.allclose(model.score(pa.array(texts, pa.string())), want)
    assert np.allclose(model.chances(pa.array(texts, pa.string())), [[1 / (1 + np.exp(k - x)) for k in (0.5, 1.0, 2.5)] for x in want])


def test_op9_fit_against_plain_steps():
    """The gradient steps in plain Python: each level's error is passed to the shared weights and the rising thresholds."""
    from math import exp, log1p, sqrt

    rng = random.Random(15)
    data = [({f: rng.randint(1, 2) for f in range(6) if rng.random() < 0.5}, rng.choice([0, 0, 1, 2, 3])) for _ in range(20)]
    rows = np.array([i for i, (x, _) in enumerate(data) for _ in x])
    cols = np.array([f for x, _ in data for f in x])
    vals = np.array([v for x, _ in data for v in x.values()], float)
    got_w, got_t = toxicity.fit_cumulative_links(rows, cols, vals, np.array([g for _, g in data]), 6, steps=30)
    toxic = sum(g > 0 for _, g in data)
    p = [0.0] * 6 + [1.0, 0.0, 0.0]
    m, v = [0.0] * 9, [0.0] * 9
    for t in range(1, 31):
        theta = [p[6], p[6] + log1p(exp(p[7])), p[6] + log1p(exp(p[7])) + log1p(exp(p[8]))]
        g = [1e-4 * w for w in p[:6]] + [0.0] * 3
        for x, grade in data:
            share = (0.5 / toxic) if grade > 0 else 0.5 / (len(data) - toxic)
            score = sum(p[f] * n for f, n in x.items())
            for k in range(3):
                err = share * (1 / (1 + exp(theta[k] - score)) - (grade > k))
                for f, n in x.items():
                    g[f] += err * n
                g[6] -= err
                for gap in range(1, k + 1):
                    g[6 + gap] -= err / (1 + exp(-p[6 + gap]))
        for i in range(9):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g[i], 0.99 * v[i] + 0.01 * g[i] ** 2
            p[i] -= 0.1 * (m[i] / (1 - 0.9**t)) / (sqrt(v[i] / (1 - 0.99**t)) + 1e-9)
    assert np.allclose(got_w, p[:6], atol=1e-6)
    assert np.allclose(got_t, [p[6], p[6] + log1p(exp(p[7])), p[6] + log1p(exp(p[7])) + log1p(exp(p[8]))], atol=1e-6)


def test_op9_long_clean_texts(spark):
    """Clean texts joined to long ones stay clean; one toxic text among them is found."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels)
    named = docs.join(labels, "doc_id").filter("length(text) between 500 and 3000").select("doc_id", "text", "toxic").collect()
    rated = toxicity.rate(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).filter("grade > 0").select("doc_id").collect()
    toxic = {r["doc_id"] for r in rated}
    clean = [r["text"] for r in sorted(named, key=lambda r: r["doc_id"]) if not r["toxic"] and r["doc_id"] not in toxic]
    long = ["\n".join(clean[i : i + 100]) for i in range(0, 800, 100)]
    got = model.chances(pa.array(long, pa.string()))[:, 0]
    print("long clean texts", got.round(3))
    assert (got < 0.5).all()


def test_op9_word_of_toxic_documents_alone(spark):
    """A word that no clean document holds counts, though few toxic ones hold it."""
    texts = [f"w{i % 7} v{i % 5} " + ("vermin" if i % 10 == 0 else "x") for i in range(80)]
    docs = spark.createDataFrame(list(enumerate([*texts, "such vermin", "such people"])), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(80)], "doc_id long, toxic int")
    rated = {r["doc_id"]: r["toxic"] for r in toxicity.rate(docs, toxicity.train(docs, labels)).collect()}
    assert rated == {i: i == 80 or (i < 80 and i % 10 == 0) for i in range(82)}


def test_hilbert_index_is_a_walk(spark):
    cells = spark.range(8**3).select((F.col("id") % 8).alias("a"), F.floor(F.col("id") / 8 % 8).alias("b"), F.floor(F.col("id") / 64).alias("c"))
    path = sorted((r["h"], (r["a"], r["b"], r["c"])) for r in cells.withColumn("h", hilbert_shards.hilbert_index([F.col(c) for c in "abc"], 3)).collect())
    assert [h for h, _ in path] == list(range(512))
    assert all(sum(abs(x - y) for x, y in zip(p, q, strict=True)) == 1 for (_, p), (_, q) in zip(path, path[1:], strict=False))


@pytest.mark.parametrize("least_rows", [20_000, 1])
def test_op10(spark, least_rows):
    docs = documents(spark)
    out = hilbert_shards.shard(docs, least_rows=least_rows).collect()
    slots = defaultdict(list)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]))
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in order] == sorted(r["hilbert"] for r in out)


def test_op10_copies_of_one_text(spark):
    """A text that fills most of its cell is cut by doc_id; places stay gapless and whole."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"))
    out = hilbert_shards.shard(docs, shards=7, least_rows=1).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert sorted(r["doc_id"] for r in out) == list(range(600)) and sorted(slots) == list(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {len(s) for s in slots.values()} <= {85, 86}


def test_op10_strings_are_ranked_whole(spark):
    """Sources with a long common start lie apart; their codes follow the order and the counts of whole strings."""
    docs = spark.range(1600).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("common_crawl_"), F.lit(2000) + F.col("id") % 8).alias("source"))
    shards = defaultdict(set)
    for r in hilbert_shards.shard(docs).join(docs.select("doc_id", "source"), "doc_id").collect():
        shards[r["source"]].add(r["shard"])
    assert all(len(v) == 2 for v in shards.values()) and len({s for v in shards.values() for s in v}) == 16


def test_op10_codes(spark):
    """Quantisation against a plain version."""
    docs = documents(spark).withColumn("source", F.when(F.col("doc_id") % 7 > 0, F.col("source")))
    codes = hilbert_shards.quantise(docs, {}, {"s": F.col("source"), "l": F.col("lang")}, 3)
    got = docs.select("source", "lang", codes["s"].alias("s"), codes["l"].alias("l")).collect()
    for column, code in (("source", "s"), ("lang", "l")):
        values = sorted((r[column] or "").encode() for r in got)
        below = {v: values.index(v) for v in set(values)}
        assert all(r[code] == below[(r[column] or "").encode()] * 8 // len(values) for r in got)


def test_op10_writes_every_row_once(spark, tmp_path):
    rows = [(1, "a", "en", "s", 7), (1, "a", "en", "s", 7), (None, "b", None, None, 8), (2, None, "de", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int")
    hilbert_shards.write_shards(docs, f"{tmp_path}/out", shards=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter(map(tuple, back.select(docs.columns).collect())) == Counter(rows) and "_shard" in back.columns
    docs.select("doc_id", "text", "lang", "source").write.mode("overwrite").parquet(f"{tmp_path}/in")
    hilbert_shards.write_shards(spark.read.parquet(f"{tmp_path}/in"), f"{tmp_path}/out2", shards=2)
    assert {r["shard"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/out2").groupBy("shard").count().collect()} == {0: 2, 1: 2}


# --- pipeline ---------------------------------------------------------------------------------


def test_pipeline(spark):
    """Each stage against its plain version, then the pieces against the documents that are left."""
    docs = documents(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.rate(docs, model).filter("toxic").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in bad]
    rows = [(i, "\n".join(kept)) for i, kept in brute_lines(rows, 10).items()]
    first = classes([i for i, _ in rows], brute_links(rows))
    rows = [(i, t) for i, t in rows if first[i] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute_hits(rows, items)
    tok = encoder()
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows if not hits[i][1]}
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] += r["length"]
    assert got == want
