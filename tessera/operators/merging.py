"""Hash-keyed diffs and merges; every mutation is a new table made from the old one and the changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff_by_key(wanted: DataFrame, existing: DataFrame, keys: list[str], digest: str = "content_sha256", has_vector: str | None = None) -> DataFrame:
    """(keys, action): insert, update, embed (same text, no vector), unchanged or delete, by one full outer join.

    Rows are told apart by a mark on each side, so a row without a digest is a row like others; two without are unchanged."""
    a = wanted.select(*keys, F.col(digest).alias("_new"), F.lit(True).alias("_wanted"))
    vector = F.col(has_vector) if has_vector else F.lit(True)
    b = existing.select(*keys, F.col(digest).alias("_old"), vector.alias("_has"), F.lit(True).alias("_had"))
    action = (
        F.when(F.col("_wanted").isNull(), "delete")
        .when(F.col("_had").isNull(), "insert")
        .when(~F.col("_new").eqNullSafe(F.col("_old")), "update")
        .when(~F.coalesce(F.col("_has"), F.lit(False)), "embed")
        .otherwise("unchanged")
    )
    return a.join(b, keys, "full").select(*keys, action.alias("action"))


def apply_diff(wanted: DataFrame, existing: DataFrame, keys: list[str], digest: str = "content_sha256", now: Column | None = None) -> DataFrame:
    """The table after the diff: wanted rows, with created_at of rows that were there; stale rows are gone."""
    now = F.current_timestamp() if now is None else now
    old = existing.select(*keys, F.col("created_at").alias("_created"), F.col("updated_at").alias("_updated"), F.col(digest).alias("_old"))
    joined = wanted.join(old, keys, "left")
    same = F.col("_old").eqNullSafe(F.col(digest))
    return joined.withColumn("created_at", F.coalesce("_created", now)).withColumn("updated_at", F.when(same, F.col("_updated")).otherwise(now)).drop("_created", "_updated", "_old")


def summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("action").agg(F.count("*").alias("n"))


def scd2_merge(history: DataFrame, targets: DataFrame, key: str, now: Column, digest: str = "content_hash", keep: Column | None = None) -> DataFrame:
    """Versioned history after a load: unchanged rows stay current, changed and vanished ones are closed, changed and
    new ones opened. `history` has key, digest, valid_from, superseded_at and the targets' columns; `keep` says
    which current rows stay though the targets lack them."""
    current, closed = history.filter("superseded_at is null"), history.filter("superseded_at is not null")
    a = targets.select(F.col(key), F.col(digest).alias("_new"))
    kept = F.lit(False) if keep is None else F.coalesce(keep, F.lit(False))
    stays = F.col("_new").eqNullSafe(F.col(digest)) | (F.col("_new").isNull() & kept)
    left = current.join(a, key, "left").withColumn("superseded_at", F.when(~stays, now)).drop("_new")
    b = current.select(F.col(key), F.col(digest).alias("_old"))
    opened = targets.join(b, key, "left").filter(~F.col("_old").eqNullSafe(F.col(digest))).drop("_old")
    opened = opened.withColumn("valid_from", now).withColumn("superseded_at", F.lit(None).cast(history.schema["superseded_at"].dataType))
    return closed.unionByName(left.select(*history.columns)).unionByName(opened.select(*history.columns))


def drift(wanted: DataFrame, existing: DataFrame, key: str, digest: str = "content_sha256") -> DataFrame:
    """(key, problem): stale, missing, drifted or no_embedding rows of a stored table against its source."""
    stale = existing.join(wanted, key, "left_anti").select(key, F.lit("stale").alias("problem"))
    missing = wanted.join(existing, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    both = wanted.select(key, F.col(digest).alias("_new")).join(existing.select(key, F.col(digest).alias("_old"), "has_vector"), key)
    drifted = both.filter("_new <> _old").select(key, F.lit("drifted").alias("problem"))
    bare = both.filter("not has_vector").select(key, F.lit("no_embedding").alias("problem"))
    return stale.unionByName(missing).unionByName(drifted).unionByName(bare)


def upsert_transcripts(stored: DataFrame, captured: DataFrame) -> DataFrame:
    """Stored conversations after a capture, by (source_host, source_ref): the same hash only restamps captured_at;
    a session id or stamp that the capture lacks is kept; a user's title outlives captures. `changed` says which rows were rewritten."""
    from tessera.functions.text import next_title

    keys = ["source_host", "source_ref"]
    old = stored.select(*keys, *(F.col(c).alias(f"_{c}") for c in stored.columns if c not in keys))
    joined = captured.join(old, keys, "full")
    was, came = F.col("_content_sha256").isNotNull(), F.col("content_sha256").isNotNull()
    changed = came & (~was | (F.col("content_sha256") != F.col("_content_sha256")))
    return joined.select(
        *keys,
        F.coalesce("content_sha256", "_content_sha256").alias("content_sha256"),
        F.when(changed, F.coalesce("session_id", "_session_id")).otherwise(F.col("_session_id")).alias("session_id"),
        F.coalesce("captured_at", "_captured_at").alias("captured_at"),
        F.when(changed, next_title(F.col("_title"), F.col("_title_source"), F.col("title"))).otherwise(F.col("_title")).alias("title"),
        F.when(changed & ~F.coalesce(F.col("_title_source") == "user", F.lit(False)), F.lit("derived")).otherwise(F.col("_title_source")).alias("title_source"),
        changed.alias("changed"),
    )


def fingerprint(df: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows and an order-free checksum of (key, digest): equal on two sides if they hold the same rows."""
    each = F.conv(F.substring(F.sha2(F.concat_ws(":", key, digest), 256), 1, 15), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n"), F.bit_xor(each).alias("checksum"))
