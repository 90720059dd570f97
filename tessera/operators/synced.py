"""A derived table that is kept up to date behind a fingerprint of its source.

The source is a set of units (a conversation, a document) with a digest each; every unit gives rows of the derived table.
A sync compares the source's signature with the published one and does nothing if they are equal. Else units are compared by
digest: only new and changed ones are read and derived, only the buckets that hold them are written anew, and units that are gone
become tombstones until their bucket is written for another reason. Versions are published by compare-and-set.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources import snapshots

#: A table of which so large a share of the units is tombstones is written anew.
MOST_TOMBSTONES = 0.2


@dataclass
class Synced:
    """The derived rows, and what the sync did: `loaded` units were read, `buckets` were written."""

    rows: DataFrame
    version: int
    stats: dict[str, int] = field(default_factory=dict)


def _bucket(key: str, n: int):
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _dealt(rows: DataFrame) -> DataFrame:
    """By bucket, where a bucket that is large goes to several tasks, each of which sorts and writes its part."""
    return rows.hint("rebalance", F.col("_bucket"))


def _read(spark: SparkSession, held: dict, kind: str, only: list[int] | None = None) -> DataFrame | None:
    parts = sorted({f"{path}/{kind}/_bucket={b}" for b, path in held["parts"].items() if only is None or int(b) in only})
    parts = [p for p in parts if snapshots.exists(spark, p)]
    schema = StructType.fromJson(json.loads(held[f"{kind}_schema"]))
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def _tombstones(spark: SparkSession, held: dict) -> DataFrame | None:
    if not held["tombstones"]:
        return None
    return spark.read.schema(StructType.fromJson(json.loads(held["dead_schema"]))).parquet(*held["tombstones"])


def rows_of(spark: SparkSession, base: str, version: int | None = None) -> DataFrame | None:
    """The published rows, without those of units that are gone."""
    version = snapshots.newest(spark, base) if version is None else version
    if not version:
        return None
    held = snapshots.manifest(spark, base, version)
    rows, dead = _read(spark, held, "rows"), _tombstones(spark, held)
    return rows if dead is None else rows.join(dead.select(held["key"]), held["key"], "left_anti")


def _checked(spark: SparkSession, base: str, within: float) -> bool:
    fs, where = snapshots.file_system(spark, f"{base}/checked")
    return within > 0 and fs.exists(where) and time.time() - fs.getFileStatus(where).getModificationTime() / 1000 < within


def sync(spark: SparkSession, base: str, signature: Callable[[], str], units: Callable[[], DataFrame], derive: Callable[[DataFrame | None], DataFrame], key: str, buckets: int = 16, check_every: float = 0, tries: int = 5) -> Synced:
    """Bring the derived table at `base` up to date and return it.

    `signature()` is cheap and equal as long as the source is; `units()` gives (key, digest), one row a unit; `derive(keys)` gives
    the rows of these units (of all units, for None) with the key among their columns. Within `check_every` seconds of the last
    check the published table is taken as it is. Units without a key are left out, and so are their rows.
    """
    told, made = units, derive
    units = lambda: told().filter(F.col(key).isNotNull())
    derive = lambda keys: made(keys).filter(F.col(key).isNotNull())
    for _ in range(tries):
        version = snapshots.newest(spark, base)
        if version and _checked(spark, base, check_every):
            return Synced(rows_of(spark, base, version), version, {"loaded": 0, "buckets": 0, "skipped": 1})
        now = signature()
        held = snapshots.manifest(spark, base, version) if version else None
        if held is None or held["signature"] != now:
            try:
                version, stats = _publish(spark, base, version, held, now, units, derive, key, buckets)
            except snapshots.Conflict:
                continue
        else:
            stats = {"loaded": 0, "buckets": 0, "inserted": 0, "updated": 0, "deleted": 0}
        fs, where = snapshots.file_system(spark, f"{base}/checked")
        fs.create(where, True).close()
        return Synced(rows_of(spark, base, version), version, stats)
    raise snapshots.Conflict(base)


def _publish(spark: SparkSession, base: str, version: int, held: dict | None, now: str, units, derive, key: str, buckets: int) -> tuple[int, dict[str, int]]:
    path = f"{base}/data-{uuid.uuid4().hex}"
    if held is None:
        fresh = units().select(key, "digest")
        fresh.withColumn("_bucket", _bucket(key, buckets)).write.partitionBy("_bucket").parquet(f"{path}/units")
        rows = derive(None)
        _dealt(rows.withColumn("_bucket", _bucket(key, buckets))).write.partitionBy("_bucket").parquet(f"{path}/rows")
        n = spark.read.parquet(f"{path}/units").count()
        content = {
            "signature": now, "key": key, "buckets": buckets, "parts": {str(b): path for b in range(buckets)}, "tombstones": [], "n_units": n, "n_dead": 0,
            "units_schema": fresh.schema.json(), "rows_schema": rows.schema.json(), "dead_schema": "",
        }
        return _commit(spark, base, 0, content, path), {"loaded": n, "buckets": buckets, "inserted": n, "updated": 0, "deleted": 0}

    buckets = held["buckets"]
    old, dead = _read(spark, held, "units"), _tombstones(spark, held)
    if dead is not None:
        old = old.join(dead.select(key), key, "left_anti")
    a = units().select(key, F.col("digest").alias("_new"), F.lit(True).alias("_wanted"))
    b = old.select(key, F.col("digest").alias("_old"), F.lit(True).alias("_had"))
    action = F.when(F.col("_wanted").isNull(), "delete").when(F.col("_had").isNull(), "insert").when(~F.col("_new").eqNullSafe(F.col("_old")), "update")
    diff = a.join(b, key, "full").select(key, F.col("_new").alias("digest"), action.alias("action")).filter("action is not null")
    diff.withColumn("_bucket", _bucket(key, buckets)).write.parquet(f"{path}/diff")
    diff = spark.read.parquet(f"{path}/diff")
    counts = {r["action"]: r["n"] for r in diff.groupBy("action").agg(F.count("*").alias("n")).collect()}
    new, gone = diff.filter("action <> 'delete'"), diff.filter("action = 'delete'")
    n_dead = held["n_dead"] + counts.get("delete", 0)
    whole = n_dead > MOST_TOMBSTONES * max(held["n_units"], 1)
    touched = list(range(buckets)) if whole else sorted(r[0] for r in new.select("_bucket").distinct().collect())
    parts, tombstones = dict(held["parts"]), list(held["tombstones"])
    if touched:
        known = diff.select(key)  # what was there of new, changed and gone units goes
        kinds = {"units": new.select(key, "digest"), "rows": derive(new.select(key)) if new.limit(1).count() else _read(spark, held, "rows", []).limit(0)}
        for kind, fresh in kinds.items():
            kept = _read(spark, held, kind, touched).join(known, key, "left_anti")
            kept = kept if dead is None else kept.join(dead.select(key), key, "left_anti")
            both = kept.unionByName(fresh.select(*kept.columns)).withColumn("_bucket", _bucket(key, buckets))
            _dealt(both).write.partitionBy("_bucket").parquet(f"{path}/{kind}")
        parts |= {str(b): path for b in touched}
    left = [gone.filter(~F.col("_bucket").isin(touched)).select(key, "_bucket")]
    if dead is not None:
        left.append(dead.filter(~F.col("_bucket").isin(touched)).select(key, "_bucket"))
    rest = left[0] if len(left) == 1 else left[0].unionByName(left[1])
    n_dead = rest.count()
    tombstones = []
    if n_dead:
        rest.write.parquet(f"{path}/dead")
        tombstones = [f"{path}/dead"]
    content = held | {
        "signature": now, "parts": parts, "tombstones": tombstones, "n_dead": n_dead, "dead_schema": rest.schema.json(),
        "n_units": held["n_units"] + counts.get("insert", 0) - counts.get("delete", 0),
    }
    stats = {"loaded": counts.get("insert", 0) + counts.get("update", 0), "buckets": len(touched), "inserted": counts.get("insert", 0), "updated": counts.get("update", 0), "deleted": counts.get("delete", 0)}
    return _commit(spark, base, version, content, path), stats


def _commit(spark: SparkSession, base: str, version: int, content: dict, path: str) -> int:
    try:
        return snapshots.commit_manifest(spark, base, version, content)
    except snapshots.Conflict:
        snapshots.drop(spark, path)
        raise
