"""Queries over tables that are kept up to date or published by several writers, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking, postings, sessions, synced
from tessera.operators.staging import base_dir, staged
from tessera.plans import derive as D
from tessera.plans import search as S
from tessera.sources import snapshots
from tessera.sources.tables import table


def _new_place(spark, name: str) -> str:
    return f"{base_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _older(df: DataFrame, key: str, text: str) -> DataFrame:
    """An older state of a table: some units are missing, some have another text, some have gone since."""
    k = F.col(key)
    old = df.filter(k % 7 != 3).withColumn(text, F.when(k % 5 == 2, F.concat(F.coalesce(text, F.lit("")), F.lit("!"))).otherwise(F.col(text)))
    return old.unionByName(df.filter(k % 4 == 1).withColumn(key, k + 1_000_000))


def _chunk_states(spark, d) -> list[synced.Synced]:
    """The chunk index of the older conversations, brought up to date, and once more with nothing to do."""
    now, base = D.turns(spark, d), _new_place(spark, "sidecar")
    states = []
    for name, turns in (("old", _older(now, "conv_id", "text")), ("new", now), ("new", now)):
        def derive(keys, turns=turns):
            return chunking.chunks(turns if keys is None else turns.join(keys, "conv_id", "left_semi")).select("conv_id", "id", "content_sha256")

        states.append(synced.sync(spark, base, lambda name=name: name, lambda turns=turns: D.conversation_digests(turns), derive, "conv_id", 8))
    return states


def sidecar_sync(spark, d):
    rows = [(i, s.version, *(s.stats[c] for c in ("loaded", "inserted", "updated", "deleted"))) for i, s in enumerate(_chunk_states(spark, d))]
    return spark.createDataFrame(rows, "step int, version int, loaded long, inserted long, updated long, deleted long")


SQL_SIDECAR = f"""
with {D.SQL_TURNS}, c as (select distinct conv_id as k from turns),
n as (select count(*) filter (k % 7 <> 3) as kept, count(*) filter (k % 4 = 1) as gone, count(*) filter (k % 7 = 3) as missing, count(*) filter (k % 7 <> 3 and k % 5 = 2) as other from c)
select 0 as step, 1 as version, kept + gone as loaded, kept + gone as inserted, 0 as updated, 0 as deleted from n
union all select 1, 2, missing + other, missing, other, gone from n
union all select 2, 2, 0, 0, 0, 0 from n
"""


def sidecar_rows(spark, d):
    """What the index holds once it is up to date."""
    return _chunk_states(spark, d)[-1].rows.select("conv_id", "id", "content_sha256")


SQL_SIDECAR_ROWS = f"with {D.SQL_CHUNKS} select conv_id, id, sha256(content) as content_sha256 from chunks"


def postings_build(spark, d):
    """The words of the documents' index that searches read, built anew: in how many texts each is, and how often."""
    snapshots.drop(spark, D._place(spark, d, "document-postings"))
    index = D.document_postings(spark, d)
    rows = spark.read.schema(postings.SEGMENT.format(id=index.held["id_type"])).parquet(*index.held["segments"])
    return rows.filter(F.col("field") == postings.WORD).groupBy("token").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_times"))


SQL_POSTINGS = """
with w as (select doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9_./:@-]+')) as token from documents)
select token, count(distinct doc_id) as n_docs, count(*) as n_times from w where length(token) >= 2 group by token
"""


def _updated_postings(spark, d, docs: DataFrame) -> postings.Index:
    """An index of older texts, brought up to date."""
    base = _new_place(spark, "postings")
    postings.sync(spark, base, lambda: "old", lambda: _older(docs, "id", "content"), buckets=16)
    return postings.sync(spark, base, lambda: "new", lambda: docs, buckets=16)


def postings_update(spark, d):
    """Hits of an index that was brought up to date: what it had of texts that changed or went counts no more."""
    return _updated_postings(spark, d, S._docs(spark, d)).search(S.TOKENS).select("id", F.round("score", 6).alias("score"))


SQL_POSTINGS_UPDATE = (
    f"with docs as (select doc_id as id, text as content from documents), {S._tfidf_sql('docs', 'content')} select id, round(score, "
    f"6) as score from scored"
)

#: Letters of the given texts that stand for ideographs, so that there is CJK text to search.
LETTERS, IDEOGRAPHS = "abcdeilmnorst", "会議記録検索結果試験文書館"
CJK_QUERY = "find 記録会議 or 索結文"


def cjk_search(spark, d):
    """Hits by bigrams of CJK runs. The made texts are stored, as both states of the index read them several times."""
    docs = staged(S._docs(spark, d).select("id", F.translate("content", LETTERS, IDEOGRAPHS).alias("content")), "cjk-documents")
    found = _updated_postings(spark, d, docs).search(postings.query_tokens(CJK_QUERY)[postings.CJK], postings.CJK)
    return found.select("id", F.round("score", 6).alias("score"))


_PAIRS = ", ".join(f"'{t}'" for t in postings.query_tokens(CJK_QUERY)[postings.CJK])
SQL_CJK_SEARCH = f"""
with r as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{IDEOGRAPHS}'), '{T._CJK}')) as run from documents),
b as (select doc_id, unnest(list_transform(range(1, length(run)), lambda i: substr(run, cast(i as bigint), 2))) as token from r),
tf as (select doc_id, token, count(*) as tf from b where token in ({_PAIRS}) group by all),
idf as (select token, pow(log10((select count(*) from documents)::double / count(*)), 2) as weight from tf group by token)
select doc_id as id, round(sum(tf * weight), 6) as score from tf join idf using (token) group by doc_id having round(sum(tf * weight), 9) > 0
"""


def _opened(spark, d) -> str:
    """Sessions published by three writers: the table, and two who open the same identities with ids of their own."""
    base, held = _new_place(spark, "sessions"), D.sessions(spark, d)
    snapshots.update(spark, base, lambda _: held, note="load")
    for n in (1, 2):
        wanted = held.filter("session_id % 10 = 0").select(*sessions.IDENTITY, (F.col("session_id") + n * 1_000_000).alias("new_id"), F.lit(False).alias("fork"))
        sessions.open_published(spark, base, wanted, D.as_of())
    return base


def opened_once(spark, d):
    """What two writers opened: an identity that both ask for has one new session, or none if one was open."""
    rows = snapshots.read(spark, _opened(spark, d))
    return rows.filter("session_id >= 1000000").select("session_id", *sessions.IDENTITY, "status")


SQL_OPENED = f"""
with {D.SQL_SESSIONS}, asked as (select agent_id, operator_id, workspace_key, lane, min(session_id) + 1000000 as session_id from sessions where session_id % 10 = 0 group by all)
select session_id, agent_id, operator_id, workspace_key, lane, 'open' as status from asked
where (agent_id, operator_id, workspace_key, lane) not in (select (agent_id, operator_id, workspace_key, lane) from sessions where status = 'open')
"""


def commit_log(spark, d):
    """The versions of a published table, with what each holds and touched."""
    base = _opened(spark, d)
    out = []
    for r in snapshots.log(spark, base).collect():  # a row a version
        rows = snapshots.read(spark, base, r["version"])
        keys = spark.read.parquet(f"{r['path']}/touched").count() if r["touched"] else 0
        out.append((r["version"], r["note"], rows.count(), keys))
    return spark.createDataFrame(out, "version long, note string, n_rows long, n_touched long")


SQL_LOG = f"""
with {D.SQL_SESSIONS}, asked as (select distinct agent_id, operator_id, workspace_key, lane from sessions where session_id % 10 = 0),
n as (select (select count(*) from sessions) as n, (select count(*) from asked) as k,
  (select count(*) from asked where (agent_id, operator_id, workspace_key, lane) not in (select (agent_id, operator_id, workspace_key, lane) from sessions where status = 'open')) as new)
select 1 as version, 'load' as note, n as n_rows, 0 as n_touched from n union all select 2, '', n + new, k from n union all select 3, '', n + new, k from n
"""

QUERIES = {f.__name__: f for f in (sidecar_sync, sidecar_rows, postings_build, postings_update, cjk_search, opened_once, commit_log)}
SQL = dict(zip(QUERIES, (SQL_SIDECAR, SQL_SIDECAR_ROWS, SQL_POSTINGS, SQL_POSTINGS_UPDATE, SQL_CJK_SEARCH, SQL_OPENED, SQL_LOG), strict=True))
