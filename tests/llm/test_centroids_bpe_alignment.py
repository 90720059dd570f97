"""Centroid clustering, BPE by rank arrays and cross-tokenizer alignment against plain versions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, rank_bpe, shallot, token_alignment

SF = "/root/testdata/sf0.001"
A, B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
BITS = [
    "word", "Word's", "don't", "x.", "a,b", "é", "é.", "́", "1234", "  ", "\n", "\n\n", "\t", " ", " ", "\x1c", "\x01", "\0", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "<s>", "<0x0A>", "▁",
    "ΣΑΣ", "İ", "ß", "日本", "\U0001f600", "...", "?!", "'s", "'LL", "</w>", "unbelievable", "x" * 70, "ab" * 90, "日本語" * 40, "     ", " ", "　", "\r\n", "\x85", "—", "“", "½", "x1", "don't,", "é1",
]


def random_texts(seed, n, longest=25):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


# --- centroids --------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, salt="1"):
    """rows: (vec_id, list of integers). Every distance is measured."""
    key = lambda r: (hashlib.sha256(f"{salt}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [list(v) for _, v in sorted(rows, key=key)[:k]]
    squared = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    for step in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda j, v=v: (squared(v, centroids[j]), j)) for _, v in rows]
        if step < rounds:
            for j in range(len(centroids)):
                inside = [v for (_, v), a in zip(rows, own, strict=True) if a == j]
                if inside:
                    centroids[j] = [sum(x) // len(inside) for x in zip(*inside, strict=True)]
    return [(i, a, squared(v, centroids[a])) for (i, v), a in zip(rows, own, strict=True)], centroids


def compare_clusters(spark, rows, k, dims, rounds=3):
    table = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got, centroids = shallot.cluster(table, k=k, rounds=rounds, dims=dims)
    want, plain = plain_clusters(rows, k, rounds)
    assert centroids.tolist() == plain
    order = lambda r: (r[0] is None, *r)
    assert sorted(map(tuple, got.select("vec_id", "a", "distance").collect()), key=order) == sorted(want, key=order)


@pytest.mark.parametrize("k", [1, 2, 5, 16])
def test_clusters_against_plain_loop(spark, k):
    rng = random.Random(k)
    centres = [[rng.randint(-60, 60) for _ in range(3)] for _ in range(7)]
    rows = [(i, [c + rng.randint(-9, 9) for c in rng.choice(centres)]) for i in range(300)]
    compare_clusters(spark, rows, k, 3)


def test_clusters_with_ties_and_copies(spark):
    """Few values: nearly all distances tie, many starting centroids are equal, some clusters are empty."""
    rng = random.Random(1)
    rows = [(i, [rng.randint(0, 2), rng.randint(0, 1)]) for i in range(120)] + [(7, [1, 1]), (7, [1, 1]), (None, [2, 0]), (None, [0, 0])]
    compare_clusters(spark, rows, 12, 2)
    compare_clusters(spark, [(i, [5, 5]) for i in range(40)], 4, 2)
    compare_clusters(spark, [(1, [-1, 4])], 4, 2)


def test_search_measures_fewer_distances():
    """Well apart clusters: bounds and balls leave most distances unmeasured, with the result of the full scan."""
    rng = np.random.default_rng(3)
    c = rng.integers(-4000, 4000, (32, 8))
    x = c[rng.integers(0, 32, 5000)] + rng.integers(-40, 40, (5000, 8))
    s = shallot.Search(c)
    a, b, upper, lower = s.assign(x, np.zeros(5000, np.int64), np.ones(5000, np.int64), np.full(5000, np.inf), np.zeros(5000))
    full = ((x[:, None, :] - c[None]) ** 2).sum(-1)
    assert (a == full.argmin(1)).all() and s.pairs < full.size
    first, s.pairs = s.pairs, 0
    again = s.assign(x, a, b, upper, lower)
    assert (again[0] == a).all() and s.pairs == 0 < first


def test_quantised_rows(spark):
    good = [0.5, -0.25]
    rows = [(1, good), (2, None), (3, [0.5]), (4, [None, 0.5]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (7, [1e300, -1e300]), (None, good), (1, good)]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<double>, a string, v int")
    most = shallot.largest_component(2)
    got = sorted(map(tuple, shallot.quantised(table, dims=2).collect()), key=repr)
    assert got == sorted([(1, [32, -16]), (1, [32, -16]), (None, [32, -16]), (7, [most, -most])], key=repr)
    assigned, centroids = shallot.cluster(shallot.quantised(table, dims=2), k=2, dims=2)
    assert shallot.with_inertia(assigned, centroids).count() == 4
    none, centroids = shallot.cluster(shallot.quantised(table.limit(0), dims=2), dims=2)
    assert shallot.with_inertia(none, centroids).collect() == []


def test_op11_floor_of_negative_components(spark):
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(np.random.default_rng(0).normal(size=(60, 64)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["v"] for r in shallot.quantised(table).collect()}
    assert got == {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}


def test_op11_on_the_table(spark):
    rows = [(r["vec_id"], [int(np.floor(64 * x)) for x in r["embedding"]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, plain = plain_clusters(rows, 16, 3)
    per = Counter()
    for _, a, d in want:
        per[a] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in plain]
    got = queries.op11_shallot(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted((i, a, d, per[a], sum(per.values()), digest[a]) for i, a, d in want)


# --- rank arrays ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


@pytest.fixture(scope="module")
def ranks():
    return rank_bpe.RankEncoder(queries.tokenizer_path())


def test_ids_and_texts_are_the_library_s(words, ranks):
    texts = random_texts(5, 1500)
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        ids, offsets = ranks(pa.array(part), 0)
        for i, t in enumerate(part):
            want = words.encode(t, add_special_tokens=False).ids
            own = ids[offsets[i] : offsets[i + 1] - 1].tolist()
            assert own == want, t
            assert ranks.decode(own) == words.decode(want, skip_special_tokens=False)


def test_long_words_as_short_ones(ranks):
    """The heap and the scan merge alike, and both as the plainest loop."""
    rng = random.Random(2)
    merges = ranks.merges
    rank = {k: (r, int(merges.results[r])) for k, r in zip(merges.keys.tolist(), merges.ranks.tolist(), strict=True)}
    for n in (1, 2, 3, 17, 64):
        word = bytes(rng.choice(b"aeintrshlo") for _ in range(n))
        ids = [*merges.inner[list(word[:-1])].tolist(), int(merges.last[word[-1]])]
        plain = list(ids)
        while True:
            found = [(rank[k][0], i) for i in range(len(plain) - 1) if (k := (plain[i] << 32) | plain[i + 1]) in rank]
            if not found:
                break
            _, i = min(found)
            plain[i : i + 2] = [rank[(plain[i] << 32) | plain[i + 1]][1]]
        assert merges.encode([word])[0].tolist() == merges._long(list(ids)) == plain


def test_word_of_one_megabyte(words, ranks):
    text = "abcdefghij" * 100_000
    ids, _ = ranks(pa.array([text]), 0)
    assert ids[:-1].tolist() == words.encode(text, add_special_tokens=False).ids


def test_decode_leaves_out_unknown_ids(words, ranks):
    ids = [0, 10**6, 49406, 49407, 320]
    assert ranks.decode(ids) == words.decode(ids, skip_special_tokens=False)
    assert ranks.decode([]) == ""


def test_op12(spark, words):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {}
    for i, t in docs.items():
        ids = words.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(words.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op12_rank_bpe(spark, SF).collect()} == want


# --- alignment --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pair():
    return token_alignment.Pair(A, B)


def plain_groups(pair, text):
    """Groups of a whole text, encoded as a whole; None without tokens."""
    if not text:
        return None
    whole = f" {text}".encode()
    a, b = pair.a.encode(f" {text}", add_special_tokens=False).ids, pair.b.encode(text)
    if b"".join(pair.bytes_a[i] for i in a) != whole or b"".join(pair.bytes_b[i] for i in b) != whole:
        return None
    ends = [np.cumsum([len(table[i]) for i in ids]).tolist() for table, ids in ((pair.bytes_a, a), (pair.bytes_b, b))]
    groups, i, j = [], 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
        groups.append((a[i:p], b[j:q]))
        i, j = p, q
    return groups


def shown(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups or [])


def plain_links(pair, rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of rows (doc_id, text)."""
    groups = [plain_groups(pair, t) for _, t in rows]
    links = [Counter((x, y) for a, b in g or [] for x in a for y in b) for g in groups]
    held = Counter(k for c in links for k in c)
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for (i, _), g, c in zip(rows, groups, links, strict=True):
        digest = "" if g is None else hashlib.sha256(shown(g).encode()).hexdigest()
        out.append((i, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), sum(c.values()), sum(n for k, n in c.items() if held[k] == most[k[0]]), sum(n * held[k] for k, n in c.items()), digest))
    return out


def test_runs_align_as_whole_texts(pair):
    own = token_alignment.Aligner(A, B)
    texts = [*random_texts(7, 1500), " ", "  ", "\n", "x ", "x\n", "\nx", "word. word, (word) word's\nword"]
    for at in range(0, len(texts), 150):
        part = texts[at : at + 150]
        slot, offsets = own.slots(pa.array(part, pa.string()))
        for i, t in enumerate(part):
            slots = slot[offsets[i] : offsets[i + 1]].tolist()
            got = None if not slots or any(own.counts[s, 0] < 0 for s in slots) else b";".join(own.shown[s] for s in slots).decode()
            want = plain_groups(pair, t)
            assert got == (None if want is None else shown(want)), t


@pytest.mark.parametrize("slice_bytes", [1, 200, 8 << 20])
def test_links_against_plain_counts(spark, pair, slice_bytes):
    rows = list(enumerate([*random_texts(8, 60, 12), None, "", "▁", "the same text, twice", "the same text, twice", "日本語" * 300, "a " * 3000]))
    rows += [(3, "again an id"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, slice string, pair int").repartition(3)
    got = token_alignment.linked(docs, A, B, slice_bytes).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_links(pair, rows), key=repr)


def test_op13(spark, pair):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.op13_token_alignment(spark, SF).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    assert sorted(got) == sorted(plain_links(pair, rows))


def test_align_gives_the_groups(spark, pair):
    texts = ["Größe of words", None, "", "▁ is no space", "日本\n\nx"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(g["a"], g["b"]) for g in r["groups"]] for r in token_alignment.align(docs, A, B).collect()}
    assert got == {i: plain_groups(pair, t) or [] for i, t in enumerate(texts)}


OPS = {
    "op12": lambda d: rank_bpe.decode(rank_bpe.encode(d, queries.tokenizer_path()), queries.tokenizer_path()),
    "op13": lambda d: token_alignment.linked(d, A, B),
    "op13_align": lambda d: token_alignment.align(d, A, B),
}


@pytest.mark.parametrize("name", OPS)
def test_awkward_rows(spark, name):
    rows = [(0, "one two"), (0, "one two"), (None, "no id"), (None, None), (1, None), (2, ""), (3, "   "), (4, "lorem ipsum dolor " * 20_000)]
    docs = spark.createDataFrame([(*r, None, "c", 1) for r in rows], "doc_id long, text string, ids string, slice string, pairs int")
    assert Counter(r["doc_id"] for r in OPS[name](docs).collect()) == Counter(i for i, _ in rows)
    assert OPS[name](docs.limit(0)).collect() == []
    assert OPS[name](docs.filter(F.lit(False))).count() == 0


# --- runs of lines and the ledger of rules ----------------------------------------------------


def test_runs_are_merged_without_shuffle_or_sort(spark, tmp_path):
    """Sorted runs are read side by side: the plans of a merge and of an anti-join have neither an exchange nor a sort."""
    from tessera.llm import line_dedup, store

    def keys(first, last):
        rows = spark.createDataFrame([(i * 7 % 50, i) for i in range(first, last)], "h1 long, h2 long").repartition(3)
        return rows.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))

    runs = line_dedup.LineRuns(spark)
    a, b = runs._write(keys(0, 400), "run"), runs._write(keys(300, 900), "run")
    assert spark.catalog.listTables() == []
    with store.sorted_reads(spark):
        merged = runs._merge([a, b])
        anti = b.join(a.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        for df in (merged, anti):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        assert merged.count() == 900 and merged.filter("n_docs = 2").count() == 100 and anti.count() == 500
        again = runs._write(merged.filter("n_docs = 1"), "run")
        assert again.count() == 800 and len(again.inputFiles()) <= runs.buckets
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"


def test_unseen_lines(spark):
    from tessera.llm import line_dedup

    runs = line_dedup.LineRuns(spark, most=3)
    batch = lambda *ids: spark.createDataFrame([(i, i) for i in ids], "h1 long, h2 long").groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
    seen = set()
    for ids in ((1, 2, 3), (2, 2, 4), (2, 5), (1, 6, 7), (7, 8)):
        assert {r["h1"] for r in runs.unseen(batch(*ids)).collect()} == set(ids) - seen
        runs.add(batch(*ids))
        seen |= set(ids)
    assert {r["h1"] for r in runs.all_repeated().collect()} == {2}


def test_ablations_of_the_stored_ledger(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = sorted(map(tuple, queries.quality_ablations(spark, SF).select("rule", "n_failed", "n_won_back").collect()))
    assert got == sorted(con.sql(queries.ORACLE_SQL["quality_ablations"]).select("rule, n_failed, n_won_back").fetchall()) and got


# --- memory of the alignment ------------------------------------------------------------------


def test_slices_come_back_without_lists_of_pairs(spark, pair):
    """Large rows lie few to a file, text reaches Python in batches of a slice, and no aggregate holds a slice's pairs as objects."""
    rows = [(i, f"word{i} of many words {i * i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    made = token_alignment.linked(docs, A, B, 100)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan
    files = [f for f in made.inputFiles() if "aligned-slices" in f]
    per_file = [spark.read.parquet(f).count() for f in set(files)]
    assert max(per_file) <= token_alignment.SLICES_PER_FILE and sum(per_file) > token_alignment.SLICES_PER_FILE
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    assert sorted(map(tuple, made.collect())) == sorted(plain_links(pair, rows))


def test_held_pairs_are_counted_some_at_a_time(pair, monkeypatch):
    own = token_alignment.Aligner(A, B)
    texts = [*random_texts(9, 40), "", "the same words, the same words", "x" * 500]
    slot, offsets = own.slots(pa.array(texts, pa.string()))
    whole = own.held_by(slot, offsets)
    monkeypatch.setattr(token_alignment, "COUNTED", 7)
    for one, other in zip(whole, own.held_by(slot, offsets), strict=True):
        assert one.tolist() == other.tolist()
    own.forget()
    assert not own.known and not len(own.pairs)
