"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, hilbert_shards, jaccard_join, language_id, line_dedup, packing, quality_rules, rank_bpe, shallot, token_alignment, token_binary, toxicity, warc


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"), threshold=0.8, n=5, recall=0.9999)
    return found.select("doc_id", "class_id", "n_copies", "n_links")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs, gram=3, dims=512, texts_per_lang=2000))


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.encode_corpus(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), most=10, least_chars=1)
    return found.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2, capacity=4096)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"), least_bytes=0)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality_rules.apply_policy(quality_rules.stored_ledger(_table(spark, sf_dir, "documents")), "v2")
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bullet_lines", "n_ellipsis_lines", "n_letter_words", "failed")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each rule of policy v2: the documents that it fails, and those that the policy would keep without it."""
    return quality_rules.ablations(quality_rules.stored_ledger(_table(spark, sf_dir, "documents")), "v2")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.rate(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards.shard(_table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op11_shallot(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = shallot.cluster(shallot.quantised(_table(spark, sf_dir, "embeddings"), dims=64), k=16, rounds=3, dims=64, salt="1")
    return shallot.with_inertia(assigned, centroids)


def op12_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    found = rank_bpe.decode(rank_bpe.encode(_table(spark, sf_dir, "documents"), path), path)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.linked(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_jaccard_join, op2_language_id, op3_token_binary, op4_line_dedup, op5_packing, op6_warc, op7_quality_rules,
        op8_decontamination, op9_toxicity, op10_hilbert_shards, op11_shallot, op12_rank_bpe, op13_token_alignment,
        quality_ablations,
    )
}

#: A line's key: ASCII white space stripped at both ends, A-Z lower-cased.
_KEYED = """
lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), hot as (
  select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10
)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _windows(width: int) -> str:
    """The windows of `w`: runs of so many words, or all of fewer."""
    return f"case when len(w) = 0 then [] else [array_to_string(w[i : i + {width - 1}], ' ') for i in range(1, greatest(len(w) - {width - 1}, 1) + 1)] end"


SQL_JACCARD = f"""
with recursive d as (select doc_id, {_WORDS} as w from documents),
s as (select distinct doc_id, unnest({_windows(5)}) as g from d),
n as (select doc_id, count(*) as n, md5(string_agg(g, '|' order by g)) as h from s group by doc_id),
copies as (select h, count(*) as c from n group by h),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where k >= 0.8 * (x.n + y.n - k) - 1e-9),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on l.a = r.b),
class as (select a, min(b) as class_id from reach group by a),
counts as (select a, count(*) as n_links from links group by a)
select d.doc_id, class_id, coalesce(c, 1) as n_copies, coalesce(n_links, 0) as n_links
from d join class on class.a = d.doc_id left join counts on counts.a = d.doc_id left join n on n.doc_id = d.doc_id left join copies on copies.h = n.h
"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((cast('0x' || substr(hex, {5 * g + 1}, 5) as bigint) >> {shift}) & 31) + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0))
SQL_WARC = f"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as hex, min(page_id) over (partition by coalesce(html, '')) as least from pages)
select page_id, payload_bytes, {_BASE32} as payload_digest, case when page_id = least then 'response' else 'revisit' end as record_type, case when page_id <> least then least end as refers_to from p
"""

_LEDGER = rf"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i : i + 7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from win) where c > 1),
rep as (select doc_id, count(distinct j) as n_repeat_words from (select doc_id, unnest(range(i, i + 8)) as j from twice) group by doc_id),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line from d),
dup as (select doc_id, count(*) as n_lines, sum(case when regexp_matches(line, '[^\x20\x09-\x0D]') then 1 else 0 end) - count(distinct case when regexp_matches(line, '[^\x20\x09-\x0D]') then line end) as n_dup_lines,
  count(*) filter (regexp_matches(line, '[^\x20\x09-\x0D]')) as n_worded_lines, count(*) filter (regexp_matches(line, '^[\x20\x09-\x0D]*[-*•]')) as n_bullet_lines,
  count(*) filter (regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) as n_ellipsis_lines from lines group by doc_id),
m as (select d.doc_id, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, n_lines, n_worded_lines, n_bullet_lines, n_ellipsis_lines, cast(len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) as bigint) as n_letter_words from d join dup using (doc_id) left join rep using (doc_id)),
f as (select *, {" + ".join(f"(case when {fails} then {quality_rules.BIT[name]} else 0 end)" for name, fails in quality_rules.RULES)} as failed from m)
"""
SQL_QUALITY = rf"""{_LEDGER}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {quality_rules.BASE}) <> 0 as base_failed, (failed & {quality_rules.POLICIES["v2"]}) = 0 as kept, n_bullet_lines, n_ellipsis_lines, n_letter_words, failed from f
"""

_MASK = quality_rules.BASE | quality_rules.POLICIES["v2"]
SQL_ABLATIONS = _LEDGER + " union all ".join(
    f"select '{name}' as rule, count(*) filter ((failed & {bit}) <> 0) as n_failed, count(*) filter ((failed & {_MASK}) = {bit}) as n_won_back from f"
    for name, bit in quality_rules.BIT.items() if bit & _MASK
)

SQL_DECONTAMINATION = f"""
with b as (select item_id, {_WORDS} as w from benchmark),
g as (select distinct cast(item_id as varchar) as item, least(len(w), 10) as n, unnest({_windows(10)}) as g from b),
d as (select doc_id, {_WORDS} as w from documents),
lengths as (select distinct n from g),
win as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lengths)),
found as (select doc_id, i, win.n, item from win join g on g.g = win.g and g.n = win.n),
hits as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from found) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from found) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""



def _assigned(step: int) -> str:
    return f"""
a{step} as (select vec_id, v, j, d from (
  select k.vec_id, k.v, c.j, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d,
         row_number() over (partition by k.vec_id order by d, c.j) as r
  from kept k, c{step} c) where r = 1)"""


def _moved(step: int) -> str:
    """Exact floor of each component's sum by the cluster's size; an empty cluster keeps its centroid."""
    return f"""
m{step} as (select j, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as v from (
  select j, i, sum(x) as s, count(*) as n from (select j, unnest(v) as x, generate_subscripts(v, 1) as i from a{step}) group by j, i) group by j),
c{step + 1} as (select c.j, coalesce(m.v, c.v) as v from c{step} c left join m{step} m on m.j = c.j)"""


SQL_SHALLOT = f"""
with kept as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as (select row_number() over (order by sha256('1:' || vec_id), v) - 1 as j, v from kept qualify j < 16),
{",".join(_assigned(i) + "," + _moved(i) for i in range(3))},
{_assigned(3)}
select vec_id, cast(a3.j as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by a3.j) as bigint) as cluster_inertia,
       cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(c3.v, ',')) as centroid_sha256
from a3 join c3 on c3.j = a3.j
"""

ORACLE_SQL: dict[str, str] = {
    "op11_shallot": SQL_SHALLOT,
    "op1_jaccard_join": SQL_JACCARD,
    "op6_warc": SQL_WARC,
    "op7_quality_rules": SQL_QUALITY,
    "quality_ablations": SQL_ABLATIONS,
    "op8_decontamination": SQL_DECONTAMINATION,
    "op4_line_dedup": f"""
with {_KEYED}
select doc_id, count(*) as n_lines, count(*) filter (where key in (select key from hot)) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where key not in (select key from hot)), '')) as kept_sha256
from keyed group by doc_id
""",
}
