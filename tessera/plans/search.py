"""Search queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import fusion, retrieval
from tessera.plans import derive as D
from tessera.sources.tables import table

QUERY = "the ingthing with erat la"
TOKENS = T.tokenize(QUERY)


def _cov(content: str) -> str:
    return "((" + " + ".join(f"(case when contains(lower({content}), '{t}') then 1 else 0 end)" for t in TOKENS) + f") / {len(TOKENS)}.0::double)"


def hybrid_search(spark, d):
    items = D.items(spark, d)
    hits = retrieval.hybrid_rank(items, QUERY, D.query_vector(spark, d))
    seq = F.expr("(seq_start + seq_end) div 2").alias("seq")
    found = hits.join(items.select("id", "seq_start", "seq_end", "content"), "id")
    return found.select("conv_id", "id", "place", F.round("score", 10).alias("score"), seq, T.snippet(F.col("content"), TOKENS).alias("snippet"))


def _snippet_sql(content: str) -> str:
    flat = f"trim(regexp_replace({content}, '\\s+', ' ', 'g'), ' ')"
    at = "coalesce(" + ", ".join(f"nullif(instr(lower(flat), '{t}'), 0)" for t in TOKENS) + ", 1)"
    return f"(select (case when s > 0 then '…' else '' end) || substr(flat, s + 1, least(length(flat), s + 180) - s) || (case when least(length(flat), s + 180) < length(flat) then '…' else '' end) from (select flat, greatest({at} - 61, 0) as s from (select {flat} as flat)))"


_FUSED = """, lists as (
  select id, 0 as list_no, row_number() over (order by score desc, id) as rank from lex
  union all select id, 1, row_number() over (order by score desc, id) from dense
), fused as (
  select id, sum(1.0::double / (60 + rank)) as rrf, min(list_no) as list_no, arg_min(rank, list_no) as list_rank from lists group by id
), ranked as (
  select f.*, row_number() over (order by round(rrf, 12) desc, list_no, list_rank, f.id) as fused_rank, i.conv_id, i.granularity from fused f join items i using (id)
), best as (
  select *, row_number() over (order by at_rank) as place from (
    select conv_id, arg_min(id, (case when granularity <> 'window' then 1000000000 else 0 end) + fused_rank) as id, max(rrf) as score, min(fused_rank) as at_rank
    from ranked group by conv_id order by at_rank limit 8)
)"""

SQL_HYBRID = f"""with {D.SQL_ITEMS}, lex as (select id, {_cov('content')} as score from items where {_cov('content')} > 0),
dense as (select id, round({D.cosine_sql('embedding', 'q.v')}, 9) as score from items, q){_FUSED}
select b.conv_id, b.id, b.place, round(b.score, 10) as score, (i.seq_start + i.seq_end) // 2 as seq, {_snippet_sql('i.content')} as snippet from best b join items i using (id)"""


def lexical_search(spark, d):
    """Without a vector the plan never reads the vector column."""
    return retrieval.hybrid_rank(D.items(spark, d), QUERY, None).select("conv_id", "id", "place", F.round("score", 10).alias("score"))


SQL_LEXICAL = f"""with {D.SQL_ITEMS}, lex as (select id, {_cov('content')} as score from items where {_cov('content')} > 0),
dense as (select id, 0 as score from items where false){_FUSED} select conv_id, id, place, round(score, 10) as score from best"""


def channel_search(spark, d):
    found = retrieval.channel_search(D.items(spark, d), QUERY, D.query_vector(spark, d), index=D.item_postings(spark, d))
    return found.select("conv_id", "id", "place", F.round("score", 10).alias("score"))


def _tfidf_sql(source: str, content: str) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) as tf{i}" for i, t in enumerate(TOKENS))
    df = ", ".join(f"case when count(*) filter (tf{i} > 0) > 0 then log10(count(*)::double / count(*) filter (tf{i} > 0)) else 0.0 end as idf{i}" for i in range(len(TOKENS)))
    score = " + ".join(f"tf{i} * idf{i} * idf{i}" for i in range(len(TOKENS)))
    return f"""tf as (select id, {tf} from (select id, string_split_regex(lower({content}), '[^a-z0-9_./:@-]+') as w from {source})),
stats as (select {df} from tf), scored as (select id, round({score}, 9) as score from tf, stats where round({score}, 9) > 0)"""


SQL_CHANNEL = f"""with {D.SQL_ITEMS}, {_tfidf_sql('items', 'content')}, lex as (select * from scored order by score desc, id limit 100),
dense as (select id, round({D.cosine_sql('embedding', 'q.v')}, 9) as score from items, q order by score desc, id limit 100){_FUSED}
select conv_id, id, place, round(score, 10) as score from best"""


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def fulltext_tfidf(spark, d):
    return D.document_postings(spark, d).search(TOKENS).orderBy(F.desc("score"), "id").limit(100).select("id", F.round("score", 6).alias("score"))


SQL_TFIDF = (
    f"with docs as (select doc_id as id, text as content from documents), {_tfidf_sql('docs', 'content')} select id, round(score, "
    f"6) as score from scored order by scored.score desc, id limit 100"
)


def lexical_rank(spark, d):
    rows = retrieval.lexical_rank(_docs(spark, d), QUERY)
    return rows.orderBy(F.desc("score"), "id").limit(50).select("id", F.round("score", 10).alias("score"))


SQL_LEXICAL_RANK = f"select doc_id as id, round({_cov('text')}, 10) as score from documents where {_cov('text')} > 0 order by score desc, id limit 50"


def keyword_fallback(spark, d):
    rows = retrieval.keyword_search(_docs(spark, d), QUERY, 10)
    return rows.select("id", "score", F.octet_length("content").alias("bytes"))


_WORDS = [w for w in QUERY.split() if len(w) > 3]
SQL_KEYWORD = "select doc_id as id, 0.5::double as score, strlen(text) as bytes from documents where " + " or ".join(f"contains(lower(text), '{w}')" for w in _WORDS) + " order by bytes desc, doc_id limit 10"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def vector_topk_exact(spark, d):
    rows = retrieval.top_by_vector(_vectors(spark, d), D.query_vector(spark, d), 100, exact=True)
    return rows.select("id", F.round("score", 6).alias("score"))


_Q = (
    "with q as (select cast(embedding as double[]) as v from embeddings where vec_id = 0), s as (select vec_id as id, label, "
    "round({}, 9) as score from embeddings, q)"
)
SQL_EXACT = _Q.format(D.cosine_sql("embedding", "q.v")) + " select id, round(score, 6) as score from s order by s.score desc, id limit 100"
_S = _Q.format(D.cosine_sql("embedding", "q.v", " + 1e-9"))


def vector_topk_floor(spark, d):
    return retrieval.top_by_vector(_vectors(spark, d), D.query_vector(spark, d), 25, floor=0.05).select("id", F.round("score", 6).alias("score"))


SQL_FLOOR = _S + " select id, round(score, 6) as score from s where s.score >= 0.05 order by s.score desc, id limit 25"


def vector_topk_types(spark, d):
    rows = retrieval.top_by_vector(_vectors(spark, d), D.query_vector(spark, d), 25, floor=0.0, where=F.col("label").isin(1, 2, 3))
    return rows.select("id", "label", F.round("score", 6).alias("score"))


SQL_TYPES = _S + " select id, label, round(score, 6) as score from s where s.score >= 0 and label in (1, 2, 3) order by s.score desc, id limit 25"


def vector_dedupe_topk(spark, d):
    q = D.query_vector(spark, d)
    from tessera.functions import vectors as V

    scored = _vectors(spark, d).withColumn("score", F.round(V.cosine_eps(F.col("embedding"), q), 9)).filter("score is not null").select("id", "label", "score")
    return retrieval.best_per_key(scored, ["label"]).orderBy(F.desc("score"), "id").limit(5).select("label", "id", F.round("score", 6).alias("score"))


SQL_DEDUPE = _S + ", k as (select *, row_number() over (partition by label order by score desc, id) as n from s) select label, id, round(score, 6) as score from k where n = 1 order by k.score desc, id limit 5"


def rrf_fuse(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars", "text")
    a = fusion.numbered(docs, F.col("n_chars").cast("double"), depth=200)
    b = fusion.numbered(docs, F.octet_length("text").cast("double"), depth=200)
    fused = fusion.fused_rank(fusion.rrf([a, b]))
    return fused.select("id", "fused_rank", F.round("rrf", 10).alias("rrf"))


SQL_RRF = """with a as (select doc_id as id, row_number() over (order by n_chars desc, doc_id) as rank from documents qualify rank <= 200),
b as (select doc_id as id, row_number() over (order by strlen(text) desc, doc_id) as rank from documents qualify rank <= 200),
l as (select id, 0 as list_no, rank from a union all select id, 1, rank from b),
f as (select id, sum(1.0::double / (60 + rank)) as rrf, min(list_no) as list_no, arg_min(rank, list_no) as list_rank from l group by id)
select id, row_number() over (order by round(rrf, 12) desc, list_no, list_rank, id) as fused_rank, round(rrf, 10) as rrf from f"""


def _stores(spark, d):
    v = _vectors(spark, d)
    return v.filter("id % 2 = 0"), v.filter("id % 2 = 1")


def joint_search(spark, d):
    return retrieval.joint_search(*_stores(spark, d), D.query_vector(spark, d))


def joint_search_cosine(spark, d):
    return retrieval.joint_search(*_stores(spark, d), D.query_vector(spark, d), use_rrf=False, floor=0.05)


def _joint_sql(floor: str, fused: str) -> str:
    return f"""{_S}, p as (select (case when id % 2 = 0 then 'kg' else 'doc' end) as store, * from s where {floor}),
r as (select store || ':' || id as key, store, score, row_number() over (partition by store order by score desc, id) as n0 from p),
t as (select *, row_number() over (partition by store order by score desc, key) as rank from r where n0 <= 12),
u as (select key, store, score, {fused} as fused from t order by fused desc, store desc, key limit 12),
w as (select *, row_number() over (partition by store order by fused desc, key) as n from u)
select key, store, round(score, 6) as score, round(fused, 10) as fused from w where n <= 6"""


SQL_JOINT = _joint_sql("true", "round(1.0::double / (60 + rank), 12)")
SQL_JOINT_COSINE = _joint_sql("score >= 0.05", "score")


def search_with_fallback(spark, d):
    """The floor leaves no vector hits, so keywords answer."""
    v = retrieval.top_by_vector(_vectors(spark, d), D.query_vector(spark, d), 5, floor=1.5).select("id", "score")
    k = retrieval.keyword_search(_docs(spark, d), QUERY, 5).select("id", "score")
    return retrieval.search_with_fallback(v, k)


SQL_FALLBACK = f"""{_S}, v as (select id, score from s where score >= 1.5 order by score desc, id limit 5),
k as (select doc_id as id, 0.5::double as score from documents where {' or '.join(f"contains(lower(text), '{w}')" for w in _WORDS)} order by strlen(text) desc, doc_id limit 5)
select id, score, 'vector-index' as mode from v union all select id, score, 'keyword' from k where not exists (select 1 from v)"""


def snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), TOKENS).alias("snippet"))


SQL_SNIPPET = f"select doc_id, {_snippet_sql('text')} as snippet from documents"


def prompt_pack(spark, d):
    hits = retrieval.top_by_vector(_vectors(spark, d), D.query_vector(spark, d), 50).select("id", "label", "score")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    block = F.concat(F.lit("["), F.col("label").cast("string"), F.lit("] "), F.col("text"))
    packed = retrieval.pack_prompt(hits.join(docs, "id"), 40_000, [F.desc("score"), "id"], block)
    return packed.select("id", "block", "total")


SQL_PACK = _S + """, h as (select * from s order by score desc, id limit 50), b as (select h.id, h.score, '[' || label || '] ' || text as block from h join documents on doc_id = h.id),
t as (select id, block, cast(sum(length(block)) over (order by score desc, id rows unbounded preceding) as bigint) as total from b) select * from t where total <= 40000"""


def message_search(spark, d):
    """Embeddings joined with their messages, filtered, the best of each kind first, then the limit."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    rows = _vectors(spark, d).join(docs, "id").join(labels, "id").filter(F.lower("lang") == "en")
    hits = retrieval.top_by_vector(rows.filter("quality = 1"), D.query_vector(spark, d), 20, floor=-1.0)
    return hits.select("id", "source", "toxic", F.round("score", 6).alias("score"))


SQL_MESSAGE = _S + """ select s.id, source, toxic, round(score, 6) as score from s join documents d on d.doc_id = s.id join labels l on l.doc_id = s.id
where lower(lang) = 'en' and quality = 1 and s.score >= -1 order by s.score desc, s.id limit 20"""

QUERIES = {
    f.__name__: f
    for f in (
        hybrid_search, lexical_search, channel_search, fulltext_tfidf, lexical_rank, keyword_fallback, vector_topk_exact,
        vector_topk_floor, vector_topk_types, vector_dedupe_topk, rrf_fuse, joint_search, joint_search_cosine, search_with_fallback,
        snippet, prompt_pack, message_search,
    )
}
SQL = dict(zip(
    QUERIES,
    (
        SQL_HYBRID, SQL_LEXICAL, SQL_CHANNEL, SQL_TFIDF, SQL_LEXICAL_RANK, SQL_KEYWORD, SQL_EXACT, SQL_FLOOR, SQL_TYPES, SQL_DEDUPE,
        SQL_RRF, SQL_JOINT, SQL_JOINT_COSINE, SQL_FALLBACK, SQL_SNIPPET, SQL_PACK, SQL_MESSAGE,
    ),
    strict=True,
))
