"""Incremental forms: liveness windows, captures and job logs as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def liveness(beats: DataFrame, minutes: int = 240, late: str = "30 minutes") -> DataFrame:
    """(session_id, host, first_seen_at, last_seen_at, beats): spells of heartbeats with no gap of `minutes`; works on streams and tables."""
    rows = beats.withWatermark("ts", late) if beats.isStreaming else beats
    spell = F.session_window("ts", f"{minutes} minutes")
    got = rows.groupBy(spell.alias("w"), "session_id", "host").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("beats"))
    return got.drop("w")


def activity(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Events a kind in tumbling (or sliding) windows."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def fold_job_log(log: DataFrame) -> DataFrame:
    """(item, status, attempt, seq) after each micro-batch of a job log (item, ts, status, bump): state kept per item.

    A status that is null keeps the last one, and one that comes late never takes a newer one back; bumps are attempts;
    seq counts the item's events."""
    from tessera.streaming.jobs import folded

    return folded(log, fields=("status",), key=None).withColumn("attempt", F.col("attempt").cast("int")).withColumn("seq", F.col("seq").cast("int"))


def capture(stream: DataFrame, base: str) -> DataStreamWriter:
    """Upsert each micro-batch of captured conversations into a published table; a batch that runs again changes nothing, and
    another writer's captures of the same time stay. Of several captures at one time the greatest hash counts."""
    from tessera.operators.merging import upsert_transcripts
    from tessera.sources import snapshots

    keys = ["source_host", "source_ref"]

    def upsert(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("captured_at", "content_sha256")).alias("r")).select(*keys, "r.*")

        def change(old: DataFrame | None) -> DataFrame:
            if old is None:
                old = newest.limit(0).withColumn("title_source", F.lit("derived"))
            return upsert_transcripts(old.select(*keys, *rest, "title_source"), newest).drop("changed")

        snapshots.update(batch.sparkSession, base, change, touched=newest.select(*keys))

    return stream.writeStream.foreachBatch(upsert)
