"""Queries over conversations and documents: chunks, titles, redaction, leaks, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import batching, chunking, quality
from tessera.plans import derive as D
from tessera.sources.tables import table


def chunk_windows(spark, d):
    return D.chunks(spark, d).filter("granularity = 'window'").select("id", "conv_id", "seq_start", "seq_end", "content", "content_sha256")


def chunk_session(spark, d):
    return D.chunks(spark, d).filter("granularity = 'session'").select("id", "conv_id", "seq_start", "seq_end", "content", "content_sha256")


def _chunk_sql(kind: str) -> str:
    return f"with {D.SQL_CHUNKS} select id, conv_id, seq_start, seq_end, content, sha256(content) as content_sha256 from chunks where granularity = '{kind}'"


def role_normalise(spark, d):
    return D.turns(spark, d).groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


SQL_ROLE = f"with {D.SQL_TURNS} select role, count(*) as n, cast(sum(length(text)) as bigint) as chars from turns group by role"


def around_turns(spark, d):
    return chunking.around(D.turns(spark, d), 3, 1).select("conv_id", "seq", "role", "text")


SQL_AROUND = f"with {D.SQL_TURNS} select conv_id, seq, role, text from turns where seq between 2 and 4"


def tail_turns(spark, d):
    return chunking.tail(D.turns(spark, d), 2).select("conv_id", "seq", "role")


SQL_TAIL = f"with {D.SQL_TURNS} select conv_id, seq, role from turns qualify row_number() over (partition by conv_id order by seq desc) <= 2"


def conversation_title(spark, d):
    return chunking.titles(D.turns(spark, d))


_LINE = r"nullif(trim(string_split(trim(regexp_replace(regexp_replace(trim(text, ' '), '^(?:@\S+\s*)+', ''), '<[^>]+>', '', 'g'), ' '), chr(10))[1], ' '), '')"
SQL_TITLE = f"""with {D.SQL_TURNS}, lines as (select conv_id, list({_LINE} order by seq) filter (where role = 'human' and {_LINE} is not null) as p from turns group by conv_id)
select conv_id, case when len(p) > 0 then case when regexp_matches(p[1], '(?i)^(?:onboard(?:ing)?|hi|hello)[\\s!.]*$') and len(p) > 1 then p[1] || ' → ' || substr(p[2], 1, 80) else substr(p[1], 1, 100) end
  else substr(cast(conv_id as varchar), 1, 8) end as title from lines"""


def listing_copy(spark, d):
    return chunking.listing_copy(D.turns(spark, d))


SQL_LISTING = f"with {D.SQL_TURNS} select conv_id, substr(arg_min(text, seq), 1, 280) as description from prose group by conv_id"


def locale_overlay(spark, d):
    """Each third turn of even conversations has a translation."""
    t = D.turns(spark, d)
    some = t.filter("seq % 3 = 1 and conv_id % 2 = 0").select("conv_id", "seq", F.lit("es").alias("locale"), F.concat(F.lit("es: "), F.col("text")).alias("text"))
    done = chunking.overlay(t, some)
    return done.select("conv_id", "locale", "seq", "role", F.sha2("text", 256).alias("text_sha256"))


SQL_OVERLAY = f"""with {D.SQL_TURNS} select conv_id, 'es' as locale, seq, role, sha256(case when seq % 3 = 1 then 'es: ' || text else text end) as text_sha256
from turns where conv_id in (select conv_id from turns where seq % 3 = 1 and conv_id % 2 = 0)"""


def query_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.tokens_of(F.col("text")), " ").alias("tokens"))


SQL_TOKENS = """with t as (select item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_./:@-]+|[一-鿿]+')) as w, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9_./:@-]+|[一-鿿]+'), 1) as k from benchmark),
u as (select item_id, lower(w) as w, min(k) as k from t where length(w) >= 2 group by 1, 2)
select b.item_id, coalesce(string_agg(w, ' ' order by k), '') as tokens from benchmark b left join u on u.item_id = b.item_id group by b.item_id"""


def redact_text(spark, d):
    safe = T.redact(F.col("text"))
    return table(spark, d, "documents").select("doc_id", safe.alias("r")).select("doc_id", F.sha2("r.text", 256).alias("text_sha256"), F.col("r.hits").alias("hits"))


_SECRET = r"""(?i)[\w.\-]*(?:password|passwd|secret|api[_-]?key|apikey|access[_-]?token|auth[_-]?token|client[_-]?secret|private[_-]?token)[\w.\-]*\s*[:=]\s*["'']?[^\s"'',;)\\]{6,}"""
SQL_REDACT = f"""with r as (select doc_id, text,
    len(regexp_extract_all(text, '\\bsk-[A-Za-z0-9_\\-]{{16,}}')) + len(regexp_extract_all(text, '\\b(?:ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]{{16,}}'))
    + len(regexp_extract_all(text, '\\bxox[abprs]-[A-Za-z0-9\\-]{{10,}}')) + len(regexp_extract_all(text, '\\bAKIA[0-9A-Z]{{16}}\\b'))
    + len(regexp_extract_all(text, '(?i)\\b(?:bearer|authorization:\\s*bearer)\\s+[A-Za-z0-9._\\-]{{16,}}')) + len(regexp_extract_all(text, '://[^\\s/:@]+:[^\\s/@\\\\]{{3,}}@'))
    + len(regexp_extract_all(text, '{_SECRET}')) as n,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\bsk-[A-Za-z0-9_\\-]{{16,}}', '[redacted:api-key]', 'g'), '\\b(?:ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]{{16,}}', '[redacted:api-key]', 'g'),
      '\\bxox[abprs]-[A-Za-z0-9\\-]{{10,}}', '[redacted:api-key]', 'g'), '\\bAKIA[0-9A-Z]{{16}}\\b', '[redacted:api-key]', 'g') as t1
  from documents)
select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(t1, '(?i)(\\b(?:bearer|authorization:\\s*bearer)\\s+)[A-Za-z0-9._\\-]{{16,}}', '\\1[redacted:bearer]', 'g'),
  '(://[^\\s/:@]+:)[^\\s/@\\\\]{{3,}}@', '\\1[redacted:connection-string]@', 'g'),
  '{_SECRET.replace('(?i)', '(?i)(').replace('?[^', '?)[^')}', '\\1[redacted:secret-assignment]', 'g')) as text_sha256, cast(n as int) as hits from r"""


def leak_scan(spark, d):
    found = quality.leak_scan(table(spark, d, "documents"), "doc_id", "text", allow=("example.org",))
    return found.select("doc_id", "line", "rule_id", "severity", "excerpt", "allowlisted")


_RULES = ", ".join("('{}', '{}', '{}')".format(i, s, p.replace("'", "''")) for i, s, p, _ in quality.LEAK_RULES)
_LEAKS = f"""rules(rule_id, severity, pattern) as (values {_RULES}),
lines as (select doc_id, unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) as content, generate_subscripts(string_split_regex(text, '\\r\\n|\\n|\\r'), 1) as line from documents),
found as (select doc_id, cast(line as int) as line, rule_id, severity, substr(trim(content, ' '), 1, 200) as excerpt, contains(content, 'example.org') as allowlisted
  from lines join rules on regexp_matches(content, pattern))"""
SQL_LEAKS = f"with {_LEAKS} select * from found"


def leak_summary(spark, d):
    return quality.leak_summary(leak_scan(spark, d))


SQL_LEAK_SUMMARY = f"with {_LEAKS} select rule_id, severity, count(*) as n, count(*) filter (allowlisted) as n_allowlisted from found group by 1, 2"


def leak_gate(spark, d):
    return quality.gate(leak_scan(spark, d))


SQL_GATE = (
    f"with {_LEAKS} select case when count(*) filter (severity = 'block' and not allowlisted) > 0 then 'FAIL' else 'PASS' end "
    f"as status, count(*) filter (severity = 'block' and not allowlisted) as n_blocking from found"
)


def workspace_key(spark, d):
    return table(spark, d, "pages").select("page_id", T.workspace_key(F.col("url")).alias("workspace_key"))


SQL_WORKSPACE = """select page_id, nullif(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url, ' '), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?', ''), '^([^/:]*):\\d+(/|$)', '\\1\\2'), '^/+|/+$', '', 'g'), '\\.git$', '')), '') as workspace_key from pages"""


def slugs(spark, d):
    return table(spark, d, "pages").select("page_id", T.slug_plain(F.col("url")).alias("plain"), T.slug_kept(F.col("url")).alias("kept"))


SQL_SLUGS = (
    r"select page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as plain, translate(url, "
    r"':\/', '---') as kept from pages"
)


def stub_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", T.stub_id(F.col("text")).alias("stub_id"))


SQL_STUBS = (
    "select doc_id, case when length('stub-' || text) <= 191 then 'stub-' || text else substr('stub-' || text, 1, 178) || '-' "
    "|| substr(sha1(text), 1, 12) end as stub_id from documents"
)


def titles_normalised(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalise_title(F.col("text")).alias("title"), T.clip(F.col("text"), 300).alias("clipped"))


SQL_TITLES = (
    r"select doc_id, nullif(substr(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), 1, 255), '') as title, case when length(text) "
    r"> 300 then substr(text, 1, 300) || '…' else text end as clipped from documents"
)


def greedy_batches(spark, d):
    return batching.batched(D.turns(spark, d), "conv_id", "seq", "text", 1500).select("conv_id", "seq", "batch")


SQL_BATCHES = f"""with recursive {D.SQL_TURNS}, t as (select conv_id, seq, length(text) as n, row_number() over (partition by conv_id order by seq) as k from turns),
go as (select conv_id, seq, k, n as size, 0 as batch from t where k = 1 union all
  select t.conv_id, t.seq, t.k, case when go.size > 0 and go.size + t.n > 1500 then t.n else go.size + t.n end, case when go.size > 0 and go.size + t.n > 1500 then go.batch + 1 else go.batch end
  from go join t on t.conv_id = go.conv_id and t.k = go.k + 1)
select conv_id, seq, cast(batch as int) as batch from go"""


def split_pieces(spark, d):
    return batching.split_pieces(D.turns(spark, d), 400)


SQL_PIECES = f"""with {D.SQL_TURNS}, cut as (select conv_id, seq, coalesce(text, '') as t, case when length(coalesce(text, '')) <= 400 then [coalesce(text, '')] else regexp_extract_all(text, '(?s)(.{{1,400}}\\z|.{{0,399}}\\n|.{{1,400}})', 1) end as p from turns),
each as (select conv_id, seq, t, len(p) as parts, unnest(p) as text, generate_subscripts(p, 1) - 1 as part from cut)
select conv_id, cast(seq as int) as seq, case when length(t) <= 400 then '' || seq else seq || '#' || part end as key, cast(part as int) as part, cast(parts as int) as parts, text from each"""


def _leet(texts):
    return {k: t.replace("e", "3") for k, t in texts.items()}


def translated(spark, d):
    """Turns in pieces through a stand-in for a translation model, and whole again."""
    return batching.translate(batching.split_pieces(D.turns(spark, d), 400), _leet)


SQL_TRANSLATED = f"with {D.SQL_TURNS} select conv_id, seq, replace(coalesce(text, ''), 'e', '3') as text from turns"


def embed_chunks(spark, d):
    """Vectors of all chunks by the built-in stand-in for a model, in bounded batches."""
    return batching.embed(D.chunks(spark, d), "id", "content", batching.hashing_embedder(32), most_items=64)


_F = (
    chunk_windows, chunk_session, role_normalise, around_turns, tail_turns, conversation_title, listing_copy, locale_overlay,
    query_tokens, redact_text, leak_scan, leak_summary, leak_gate, workspace_key, slugs, stub_ids, titles_normalised, greedy_batches,
    split_pieces, translated,
)
QUERIES = {f.__name__: f for f in (*_F, embed_chunks)}
SQL = dict(zip(
    (f.__name__ for f in _F),
    (
        _chunk_sql("window"), _chunk_sql("session"), SQL_ROLE, SQL_AROUND, SQL_TAIL, SQL_TITLE, SQL_LISTING, SQL_OVERLAY, SQL_TOKENS,
        SQL_REDACT, SQL_LEAKS, SQL_LEAK_SUMMARY, SQL_GATE, SQL_WORKSPACE, SQL_SLUGS, SQL_STUBS, SQL_TITLES, SQL_BATCHES, SQL_PIECES,
        SQL_TRANSLATED,
    ),
    strict=True,
))
