"""Sessions, checkpoints, hosts, decisions and workspace aliases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import text as T
from tessera.sources import snapshots


def matching(df: DataFrame, **values) -> DataFrame:
    """Rows that equal every value given; an empty or missing value is no filter."""
    tests = [F.col(c) == v for c, v in values.items() if v]
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def page(df: DataFrame, order: list[Column], limit: int | None = 50, offset: int | None = 0) -> DataFrame:
    """A page of rows; limits are held to 1..500 and offsets to 0..100000, a bad value is the default."""

    def held(value, default: int, low: int, high: int) -> int:
        try:
            return max(low, min(high, int(value)))
        except (TypeError, ValueError):
            return default

    return df.orderBy(*order).offset(held(offset, 0, 0, 100_000)).limit(held(limit, 50, 1, 500))


def latest(df: DataFrame, key: str, when: str, tie: str) -> DataFrame:
    """The newest row of each key, by a grouped maximum that needs no sort."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(when, tie)).alias("_r")).select(key, "_r.*")


def resume(sessions: DataFrame, checkpoints: DataFrame, key: list[str]) -> DataFrame:
    """For each key its open session, else its newest parked one, with the session's newest checkpoint."""
    order = F.struct((F.col("status") == "open").cast("int"), "updated_at", "session_id")
    rest = [c for c in sessions.columns if c not in key]
    chosen = sessions.filter(F.col("status").isin("open", "parked")).groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("s")).select(*key, "s.*")
    last = checkpoints.groupBy("session_id").agg(F.max_by("checkpoint_id", F.struct("created_at", "checkpoint_id")).alias("checkpoint_id"), F.max("created_at").alias("checkpointed_at"))
    return chosen.join(last, "session_id", "left")


def heartbeats(events: DataFrame) -> DataFrame:
    """(session_id, host): first and last seen, and the editor of the last beat."""
    return events.groupBy("session_id", "host").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.max_by("ide", F.struct("ts", "ide")).alias("ide"))


def live_hosts(hosts: DataFrame, as_of: Column, minutes: int = 240, but: str | None = None) -> DataFrame:
    """Hosts seen in the last `minutes` (0 at least), without one host."""
    rows = hosts.filter(F.col("last_seen_at") >= as_of - F.expr(f"INTERVAL {max(0, minutes)} MINUTE"))
    return rows.filter(F.col("host") != but) if but else rows


def implied_activity(sessions: DataFrame, as_of: Column, minutes: int = 240) -> DataFrame:
    """Sessions touched in the last minutes by a checkpoint or an update."""
    at = F.greatest(F.coalesce("last_checkpoint_at", "updated_at"), F.col("updated_at"))
    return sessions.filter(F.col("updated_at").isNotNull() & (at >= as_of - F.expr(f"INTERVAL {max(0, minutes)} MINUTE")))


def other_lanes(sessions: DataFrame, lane: str, as_of: Column, stale_hours: int = 72) -> DataFrame:
    """Open sessions in other lanes with whole idle hours and whether they are stale."""
    idle = F.timestamp_diff("HOUR", F.greatest(F.coalesce("last_checkpoint_at", "updated_at"), F.col("updated_at")), as_of)
    return sessions.filter((F.col("status") == "open") & (F.col("lane") != lane)).withColumn("idle_hours", idle).withColumn("stale", F.col("idle_hours") >= stale_hours)


def hours_since_checkpoint(checkpoints: DataFrame, as_of: Column, key: str = "session_id") -> DataFrame:
    """Age of each session's newest checkpoint: whole minutes as hours."""
    last = checkpoints.groupBy(key).agg(F.max("created_at").alias("last"))
    return last.select(key, (F.timestamp_diff("MINUTE", F.col("last"), as_of) / F.lit(60.0)).alias("hours"))


def is_stale(hours: Column, least: float) -> Column:
    """No checkpoint at all counts as stale."""
    return F.coalesce(hours >= least, F.lit(True))


def host_switch(other_live: Column, checkpoint_host: Column, host: Column) -> Column:
    """contention if another host is live, handoff if the last checkpoint is of another, else none."""
    return F.when(other_live, "contention").when(checkpoint_host.isNotNull() & (checkpoint_host != host), "handoff").otherwise("none")


def decisions(checkpoints: DataFrame, limit: int | None = None) -> DataFrame:
    """A row a decision of (checkpoint_id, created_at, decisions, supersedes): with the newest checkpoint that supersedes its own."""
    newest = [F.desc("created_at"), F.desc("checkpoint_id")]
    read = checkpoints.filter("size(decisions) > 0 or size(supersedes) > 0")
    read = read.orderBy(*newest).limit(limit) if limit else read
    over = read.select(F.explode("supersedes").alias("old"), "checkpoint_id", "created_at").groupBy("old").agg(F.max_by("checkpoint_id", F.struct("created_at", "checkpoint_id")).alias("superseded_by"))
    out = read.select("checkpoint_id", "created_at", F.posexplode("decisions").alias("pos", "decision")).join(over, F.col("checkpoint_id") == F.col("old"), "left").drop("old")
    return out.orderBy(*newest, "pos").limit(limit) if limit else out


def resolve_alias(df: DataFrame, aliases: DataFrame, column: str = "workspace_key") -> DataFrame:
    """Workspace keys with one hop of aliases followed; keys without an alias stay."""
    a = aliases.select(F.col("alias_key").alias(column), F.col("canonical_key").alias("_to"))
    return df.join(a, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def alias_refusals(proposed: DataFrame, aliases: DataFrame) -> DataFrame:
    """Why an alias can't be added: it names itself, its target is an alias, or it is taken; null if it can."""
    taken = aliases.select("alias_key", F.lit(True).alias("_taken"))
    chained = aliases.select(F.col("alias_key").alias("canonical_key"), F.lit(True).alias("_chained")).distinct()
    joined = proposed.join(taken, "alias_key", "left").join(chained, "canonical_key", "left")
    why = F.when(F.col("alias_key") == F.col("canonical_key"), "self").when(F.col("_chained"), "chained").when(F.col("_taken"), "existing")
    return joined.select("alias_key", "canonical_key", why.alias("refusal"))


def open_collisions(sessions: DataFrame, alias: DataFrame) -> DataFrame:
    """Pairs of open sessions that a refiling would bring under one identity (agent, operator, lane)."""
    a = sessions.filter("status = 'open'").join(alias, F.col("workspace_key") == F.col("alias_key")).select("agent_id", "operator_id", "lane", F.col("canonical_key").alias("workspace_key"), F.col("session_id").alias("alias_session"))
    b = sessions.filter("status = 'open'").select("agent_id", "operator_id", "lane", "workspace_key", F.col("session_id").alias("canonical_session"))
    return a.join(b, ["agent_id", "operator_id", "lane", "workspace_key"]).filter("alias_session <> canonical_session")


def open_key(agent: Column, operator: Column, workspace: Column, lane: Column, status: Column) -> Column:
    """The identity of an open session: at most one open session has it. Null if it isn't open."""
    return F.when(status == "open", F.sha2(F.concat_ws("\n", agent, operator, workspace, lane), 256))


def duplicate_open(sessions: DataFrame) -> DataFrame:
    key = open_key(*(F.col(c) for c in ("agent_id", "operator_id", "workspace_key", "lane", "status")))
    return sessions.select(key.alias("open_key")).filter("open_key is not null").groupBy("open_key").agg(F.count("*").alias("n")).filter("n > 1")


def set_status(sessions: DataFrame, session_id: str, status: str, now: Column) -> DataFrame:
    me = F.col("session_id") == session_id
    return sessions.withColumn("status", F.when(me, F.lit(status)).otherwise(F.col("status"))).withColumn("updated_at", F.when(me, now).otherwise(F.col("updated_at")))


#: What a session can be.
STATUSES = ("open", "parked", "closed")
IDENTITY = ["agent_id", "operator_id", "workspace_key", "lane"]


def open_sessions(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """What opening does: (session_id, action, agent_id, operator_id, workspace_key, lane, parent_session_id).

    `requests` are identities with a `new_id` and `fork`. Where an identity has an open session it is reused, or, for
    a fork, parked, and the new one has it as its parent; else the new one is inserted. Of several requests for one
    identity the smallest new_id wins (a fork before others); the rest reuse what the winner opened.
    """
    open_ = sessions.filter("status = 'open'").groupBy(*IDENTITY).agg(F.max_by("session_id", F.struct("updated_at", "session_id")).alias("_open"))
    first = requests.groupBy(*IDENTITY).agg(F.min_by(F.struct("new_id", "fork"), F.struct((~F.col("fork")).cast("int"), "new_id")).alias("_w"))
    ways = first.join(open_, IDENTITY, "left").select(*IDENTITY, "_w.new_id", "_w.fork", "_open")
    inserts = ways.filter("_open is null or fork").select(F.col("new_id").alias("session_id"), F.lit("insert").alias("action"), *IDENTITY, F.col("_open").alias("parent_session_id"))
    none = F.lit(None).cast(inserts.schema["parent_session_id"].dataType).alias("parent_session_id")
    parks = ways.filter("_open is not null and fork").select(F.col("_open").alias("session_id"), F.lit("park").alias("action"), *IDENTITY, none)
    result = ways.select(*IDENTITY, F.col("new_id").alias("_winner"), F.when(F.col("_open").isNull() | F.col("fork"), F.col("new_id")).otherwise(F.col("_open")).alias("session_id"), (F.col("_open").isNotNull() & ~F.col("fork")).alias("_all"))
    reuses = requests.join(result, IDENTITY).filter("_all or new_id <> _winner").select("session_id", F.lit("reuse").alias("action"), *IDENTITY, none)
    return inserts.unionByName(parks).unionByName(reuses)


def apply_open(sessions: DataFrame, actions: DataFrame, now: Column) -> DataFrame:
    """The sessions after `open_sessions`: parked ones updated, inserted ones added as open; other columns are null there."""
    parked = actions.filter("action = 'park'").select("session_id", F.lit(True).alias("_parked"))
    kept = sessions.join(parked, "session_id", "left")
    kept = kept.withColumn("status", F.when(F.col("_parked"), "parked").otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("_parked"), now).otherwise(F.col("updated_at"))).drop("_parked")
    new = actions.filter("action = 'insert'").select("session_id", *IDENTITY, "parent_session_id", F.lit("open").alias("status"), now.alias("updated_at"))
    return kept.unionByName(new, allowMissingColumns=True)


def open_published(spark: SparkSession, base: str, requests: DataFrame, now: Column) -> int:
    """Open sessions in a published table and return the version that holds them. If another writer published meanwhile, what
    to do is decided again from what that one left: two requests for one identity end up with one open session."""
    return snapshots.update(spark, base, lambda held: apply_open(held, open_sessions(held, requests), now), touched=requests.select(*IDENTITY))


def append_checkpoints(checkpoints: DataFrame, sessions: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checkpoints with new ones of known sessions added, and the sessions with `last_checkpoint_at` and `updated_at`
    moved to their newest new checkpoint (never back)."""
    known = new.join(sessions.select("session_id"), "session_id", "left_semi")
    last = known.groupBy("session_id").agg(F.max("created_at").alias("_at"))
    touched = sessions.join(last, "session_id", "left")
    for column in ("last_checkpoint_at", "updated_at"):
        touched = touched.withColumn(column, F.greatest(column, "_at"))
    return checkpoints.unionByName(known.select(*checkpoints.columns)), touched.drop("_at")


def set_titles(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Titles set by a user (key, title): white space collapsed, blank ones ignored; no timestamp moves."""
    new = changes.select(key, T.normalise_title(F.col("title")).alias("_title")).filter("_title is not null")
    joined = df.join(new, key, "left")
    source = F.when(F.col("_title").isNotNull(), "user").otherwise(F.col("title_source"))
    return joined.withColumn("title_source", source).withColumn("title", F.coalesce("_title", "title")).drop("_title")


def change_statuses(sessions: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Sessions with the statuses of `changes` (session_id, status: open, parked or closed; the last by status order if several), and
    `updated_at` moved where one changed. Unknown statuses are refused: those rows stay as they are."""
    known = changes.filter(F.col("status").isin(*STATUSES)).groupBy("session_id").agg(F.max("status").alias("_new"))
    joined = sessions.join(known, "session_id", "left")
    moves = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("status"))
    return joined.withColumn("updated_at", F.when(moves, now).otherwise(F.col("updated_at"))).withColumn("status", F.coalesce("_new", "status")).drop("_new")


def set_presentations(transcripts: DataFrame, changes: DataFrame, key: str = "transcript_id") -> tuple[DataFrame, DataFrame]:
    """Transcripts with the presentations of `changes` (key, title, description, turns by locale) after `indexing.normalise_presentation`;
    no timestamp moves. And the keys of changes that no transcript has."""
    from tessera.operators.indexing import normalise_presentation

    pack = normalise_presentation(F.col("title"), F.col("description"), F.col("turns"))
    new = changes.select(key, pack.alias("_pack"), F.lit(True).alias("_told"))
    joined = transcripts.join(new, key, "left")
    out = joined.withColumn("presentation", F.when(F.col("_told"), F.col("_pack")).otherwise(F.col("presentation"))).drop("_pack", "_told")
    return out, changes.join(transcripts.select(key), key, "left_anti").select(key)


def refile(tables: dict[str, DataFrame], aliases: DataFrame, column: str = "workspace_key") -> dict[str, DataFrame]:
    """Every table with its workspace keys moved to their canonical ones; no timestamp moves."""
    return {name: resolve_alias(df, aliases, column) for name, df in tables.items()}


def is_auto(payload: Column) -> Column:
    """Whether a checkpoint's JSON payload says that it was made by itself."""
    return F.coalesce(F.get_json_object(payload, "$.checkpoint_kind") == "auto", F.lit(False))


def session_records(sessions: DataFrame) -> DataFrame:
    """Sessions as records: a missing lane is `default`, a missing title source `derived`, missing counts 0, times ISO text."""
    fills = {"lane": "default", "title_source": "derived", "turn_count": 0, "checkpoint_count": 0}
    out = sessions
    for column, value in fills.items():
        if column in out.columns:
            out = out.withColumn(column, F.coalesce(F.col(column), F.lit(value)))
    for column, kind in out.dtypes:
        if kind.startswith("timestamp"):
            out = out.withColumn(column, F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"))
    return out


def tree(sessions: DataFrame) -> DataFrame:
    """Every session with its root and depth; a parent outside the workspace makes a root."""
    from tessera.operators.graph import ancestors

    inside = sessions.select(F.col("session_id").alias("parent_session_id"), F.col("workspace_key").alias("_w"))
    own = sessions.join(inside, "parent_session_id", "left").withColumn("parent_session_id", F.when(F.col("_w") == F.col("workspace_key"), F.col("parent_session_id"))).drop("_w")
    return ancestors(own.select("session_id", "parent_session_id")).join(own, "session_id")


def ordered_tree(sessions: DataFrame, order: str = "created_at", path: bool = True) -> DataFrame:
    """Every session of a workspace's forest in reading order (`forest.preorder`): a parent outside the workspace makes a root."""
    from tessera.operators import forest

    inside = sessions.select(F.col("session_id").alias("parent_session_id"), F.col("workspace_key").alias("_w"))
    own = sessions.select("session_id", "parent_session_id", "workspace_key", order).join(inside, "parent_session_id", "left")
    own = own.withColumn("parent_session_id", F.when(F.col("_w") == F.col("workspace_key"), F.col("parent_session_id")))
    placed = forest.preorder(own, "session_id", "parent_session_id", order, path)
    return placed.join(own.select("session_id", "workspace_key", order), "session_id")


def workspaces(sessions: DataFrame, newest: int = 200) -> DataFrame:
    """Distinct workspaces of the newest sessions, sorted."""
    return sessions.orderBy(F.desc("updated_at"), "session_id").limit(newest).select("workspace_key").distinct().orderBy("workspace_key")


def with_seq(events: DataFrame, run: str = "run_id", ts: str = "ts", key: str = "event_id") -> DataFrame:
    return events.withColumn("seq", F.row_number().over(W.partitionBy(run).orderBy(ts, key)))
