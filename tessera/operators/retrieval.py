"""Lexical, vector and hybrid search as one declarative plan for each query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import fusion, threshold
from tessera.operators.postings import CJK, WORD, Index, query_tokens
from tessera.operators.staging import staged


def lexical_rank(df: DataFrame, query: str, content: str = "content") -> DataFrame:
    """Rows with a token of the query, `score` being the share of its tokens that occur."""
    return df.withColumn("score", T.coverage(T.tokenize(query), F.col(content))).filter("score > 0")


def top_by_vector(df: DataFrame, query: list[float], limit: int = 25, floor: float | None = None, exact: bool = False, where: Column | None = None, key: str = "id", vector: str = "embedding") -> DataFrame:
    """The nearest rows by cosine (rounded to 9 places so that ties are by key). Filters come before scoring; the
    floor after the limit, which gives the same rows and scores each row once."""
    rows = (df if where is None else df.filter(where)).filter(F.size(vector) == len(query))
    score = (V.cosine if exact else V.cosine_eps)(F.col(vector), query)
    rows = rows.withColumn("score", F.round(score, 9)).orderBy(F.desc("score"), key).limit(limit).filter("score is not null")
    return rows if floor is None else rows.filter(F.col("score") >= floor)


def best_per_key(df: DataFrame, keys: list[str], tie: str = "id") -> DataFrame:
    """The best scored row of each key; a grouped maximum, so it is summed before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("score", -F.col(tie))).alias("_b"))
    return best.select(*keys, "_b.*")


def hybrid_rank(items: DataFrame, query: str, vector: list[float] | None, limit: int = 8, k: int = 60, group: str = "conv_id") -> DataFrame:
    """Lexical and vector ranks of all items fused, one pointer a conversation. Without a vector only the
    lexical list counts, and the vector column is not read.

    Lists are read as deep as the answer needs (`threshold`); only if that is very deep are they ranked as a whole."""
    scores = [F.nullif(T.coverage(T.tokenize(query), F.col("content")), F.lit(0.0))]
    if vector is not None:
        scores.append(F.round(V.cosine(F.col("embedding"), vector), 9))
    found = threshold.first_groups(items, scores, group, F.col("granularity"), limit=limit, k=k)
    return found if found is not None else ranked_as_a_whole(items, scores, limit, k, group)


def ranked_as_a_whole(items: DataFrame, scores: list[Column], limit: int = 8, k: int = 60, group: str = "conv_id") -> DataFrame:
    """The same by global ranks of all items."""
    fused = fusion.rrf([fusion.numbered(items, s) for s in scores], k=k).join(items.select("id", group, "granularity"), "id")
    return fusion.collapse(fused, group, F.col("granularity"), limit=limit)


def channel_search(items: DataFrame, query: str, vector: list[float] | None, limit: int = 8, depth: int = 100, k: int = 60, group: str = "conv_id", index: Index | None = None, within: bool = False) -> DataFrame:
    """As hybrid_rank, but each channel gives its own best `depth` rows and neither filters the other.

    Words are looked up in the `index` of the items, and so are the bigrams of the query's CJK runs; the ids that only
    these find come after the others in the same list. Without an index the texts are searched: for words, and in a column
    `content_cjk` for the share of the query's CJK tokens that it holds. `within` says that
    `items` are only some of the indexed ones: then the others go before a channel is cut (counts of documents stay those of all)."""
    tokens = query_tokens(query)

    def found(field: int) -> DataFrame:
        scored = index.search(tokens[field], field)
        return fusion.numbered(scored.join(items.select("id"), "id", "left_semi") if within else scored, F.col("score"), depth=depth)

    lexical = found(WORD) if index else fusion.numbered(tfidf(items, query), F.col("score"), depth=depth)
    cjk = [t for t in T.tokenize(query) if t[0] >= "㐀"]
    more = None
    if index and tokens[CJK]:
        more = found(CJK)
    elif not index and cjk and "content_cjk" in items.columns:
        more = fusion.numbered(items.filter("content_cjk is not null"), F.nullif(T.coverage(cjk, F.col("content_cjk")), F.lit(0.0)), depth=depth)
    if more is not None:
        both = lexical.select("id", F.col("rank")).unionByName(more.select("id", (F.col("rank") + depth).alias("rank")))
        both = both.groupBy("id").agg(F.min("rank").alias("at"))
        lexical = both.withColumn("rank", F.row_number().over(W.orderBy("at"))).drop("at")
    lists = [lexical]
    if vector is not None:
        lists.append(fusion.numbered(items, F.round(V.cosine(F.col("embedding"), vector), 9), depth=depth))
    fused = fusion.rrf(lists, k=k)
    return fusion.collapse(fused.join(items.select("id", group, "granularity"), "id"), group, F.col("granularity"), limit=limit)


def tfidf(items: DataFrame, query: str, content: str = "content") -> DataFrame:
    """(id, score): sum over the query's words of tf * log10(N / df) squared, tf being whole-word counts.

    One scan counts each word where a text holds it at all; the counts (texts with none left out) are kept,
    and give both the words' documents and the scores."""
    words = [w for w in T.tokenize(query) if w[0] < "㐀"]
    if not words:
        return items.select("id", F.lit(0.0).alias("score")).limit(0)
    edge = "[a-z0-9_./:@-]"

    def times(word: str) -> Column:
        whole = F.lit(rf"(?<!{edge})\Q{word}\E(?!{edge})")
        return F.when(F.contains("low", F.lit(word)), F.regexp_count("low", whole)).otherwise(0)

    tf = [f"tf{i}" for i in range(len(words))]
    counted = items.select("id", F.lower(F.col(content)).alias("low")).select("id", *(times(w).alias(c) for w, c in zip(words, tf, strict=True)))
    counted = staged(counted.filter(reduce(Column.__or__, (F.col(c) > 0 for c in tf))), "tf")
    total = items.agg(F.count("*").alias("n")).scalar()
    idf = F.array(*(F.when(F.count_if(F.col(c) > 0) > 0, F.log10(total / F.count_if(F.col(c) > 0))).otherwise(0.0) for c in tf))
    # One row of statistics, as a scalar subquery.
    weighed = counted.withColumn("idf", counted.agg(idf.alias("idf")).scalar())
    score = sum((F.col(c) * F.get("idf", F.lit(i)) * F.get("idf", F.lit(i)) for i, c in enumerate(tf)), F.lit(0.0))
    return weighed.select("id", F.round(score, 9).alias("score")).filter("score > 0")


def candidates(items: DataFrame, query: str, most: int = 400) -> DataFrame:
    """The items of the `most` best full-text scores, or all items if there is no score at all.

    A pre-filter that costs recall: what it leaves out no later rank can bring back. It is off by default."""
    best = staged(tfidf(items, query).orderBy(F.desc("score"), "id").limit(most).select("id"), "candidates")
    return items.join(F.broadcast(best), "id", "left_semi") if best.count() else items


def archive_search(items: DataFrame, query: str, vector: list[float] | None = None, workspace_key: str | None = None, since: Column | None = None, model: str | None = None, limit: int = 8, mode: str = "scan", most_candidates: int | None = None, index: Index | None = None) -> DataFrame:
    """Search of an archive of items (id, conv_id, granularity, content, embedding; workspace_key, captured_at and
    embedding_model where they are asked for): one pointer a conversation, as `hybrid_rank` ("scan") or `channel_search`
    ("channels") gives it. A blank query finds nothing; `since` leaves out items without a time; vectors of another
    model don't count. `most_candidates` turns the pre-filter on; `index` serves the channels."""
    if mode not in ("scan", "channels"):
        raise ValueError(f"unknown mode {mode}")
    rows = items if query.strip() else items.limit(0)
    if workspace_key:
        rows = rows.filter(F.col("workspace_key") == workspace_key)
    if since is not None:
        rows = rows.filter(F.col("captured_at") >= since)
    if most_candidates:
        rows = candidates(rows, query, most_candidates)
    if model and vector is not None:
        rows = rows.withColumn("embedding", F.when(F.col("embedding_model") == model, F.col("embedding")))
    if mode == "channels":
        return channel_search(rows, query, vector, limit=limit, index=index, within=rows is not items)
    return hybrid_rank(rows, query, vector, limit=limit)


def message_filters(df: DataFrame, agent: str | None = None, **equal: str | None) -> DataFrame:
    """Messages (reporter, recipient and any columns) that an agent sent or got, with equal values; missing filters don't count."""
    if agent:
        df = df.filter((F.lower("reporter") == agent.lower()) | (F.lower("recipient") == agent.lower()))
    for column, value in equal.items():
        df = df.filter(F.col(column) == value) if value else df
    return df


def message_search(messages: DataFrame, query: list[float], limit: int = 5, floor: float = 0.0, dedupe: list[str] | None = None, **filters: str | None) -> DataFrame:
    """Nearest messages: those at the floor or above that pass the filters, the best of each `dedupe` key, then the limit."""
    rows = message_filters(messages, **filters).filter(F.size("embedding") == len(query))
    rows = rows.withColumn("score", F.round(V.cosine_eps(F.col("embedding"), query), 9)).filter(F.col("score") >= floor).drop("embedding")
    return (best_per_key(rows, dedupe) if dedupe else rows).orderBy(F.desc("score"), "id").limit(limit)


def tags_of(json: Column) -> Column:
    """A JSON list of strings; an empty list where the text is missing or can't be read."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def plan_search(plans: DataFrame, query: list[float], limit: int = 5, floor: float = 0.0, model: str | None = None, **filters: str | None) -> DataFrame:
    """Nearest plans (id, embedding, tags as JSON, and columns to filter by: lifecycle, status, owner, project, task)."""
    rows = plans.filter(F.col("embedding_model") == model) if model else plans
    for column, value in filters.items():
        rows = rows.filter(F.col(column) == value) if value else rows
    return top_by_vector(rows, query, limit, floor=floor).withColumn("tags", tags_of(F.col("tags")))


def keyword_search(df: DataFrame, query: str, limit: int, content: str = "content", topic: str | None = None, key: str = "id") -> DataFrame:
    """Rows that hold a word of over three letters, longest content (in bytes) first, all with score 0.5; none without words."""
    words = [w for w in query.lower().split() if len(w) > 3]
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower(content), F.lit(w))
        if topic:
            hit = hit | F.contains(F.lower(topic), F.lit(w))
    return df.filter(hit).withColumn("score", F.lit(0.5)).orderBy(F.desc(F.octet_length(content)), key).limit(limit)


def search_with_fallback(vector_hits: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """Vector hits if there are any, else keyword hits; one plan, the choice is a scalar subquery."""
    a = vector_hits.withColumn("mode", F.lit("vector-index"))
    none = vector_hits.agg((F.count("*") == 0).alias("none")).scalar()
    b = keyword_hits.withColumn("mode", F.lit("keyword")).filter(none)
    return a.unionByName(b)


def joint_mode(query: str, vector: list[float] | None, use_rrf: bool = True) -> str:
    """How a joint search answers: `empty` (a blank query), `no_embed` (it has no vector), `rrf` or `cosine`."""
    return "empty" if not (query or "").strip() else "no_embed" if not vector else "rrf" if use_rrf else "cosine"


def joint_search(kg: DataFrame, docs: DataFrame, query: list[float] | None, top_k: int = 6, per_store: int = 12, floor: float = 0.22, use_rrf: bool = True, k: int = 60, node: str | None = None) -> DataFrame:
    """Best rows of two stores: fused by rank, or by cosine with a floor. Stops at 2 * top_k overall, then top_k a store.

    `node` names the column of the first store that tells its nodes (where it is null, the row's id does): by rank, the chunks of
    one node add up to one hit with the score of the best; by cosine each chunk is a hit. Without a vector nothing is found."""
    parts = []
    for store, df in (("kg", kg), ("doc", docs)):
        df = df if query else df.limit(0)
        hits = top_by_vector(df, query or [0.0], limit=per_store, floor=None if use_rrf else floor)
        name = F.coalesce(F.col(node).cast("string"), F.col("id").cast("string")) if node and store == "kg" and use_rrf else F.col("id").cast("string")
        ranked = hits.select(F.concat(F.lit(store + ":"), name).alias("key"), F.lit(store).alias("store"), "id", "score")
        parts.append(ranked.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id"))))
    both = parts[0].unionByName(parts[1])
    if use_rrf:
        both = both.groupBy("store", "key").agg(F.min_by("score", "rank").alias("score"), F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 12).alias("fused"))
    else:
        both = both.withColumn("fused", F.col("score"))
    cut = both.orderBy(F.desc("fused"), F.desc("store"), "key").limit(2 * top_k)
    w = W.partitionBy("store").orderBy(F.desc("fused"), "key")
    return cut.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= top_k).select("key", "store", F.round("score", 6).alias("score"), F.round("fused", 10).alias("fused"))


def pack_prompt(ranked: DataFrame, most_chars: int, order: list, block: Column) -> DataFrame:
    """Blocks in order while their running length fits; the rows are one query's hits."""
    rows = ranked.withColumn("block", block)
    return rows.withColumn("total", F.sum(F.length("block")).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).filter(F.col("total") <= most_chars)
