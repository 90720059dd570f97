"""A job log as a stream: events numbered in event time, and items folded, with state on RocksDB.

However the log is cut into micro-batches, the results are those of `sessions.with_seq` and `jobs.fold_items` over the whole log. An
item's fields carry the place in the log of their last value, so an event that comes late never takes a newer one back.
Numbers can't be given back, so events wait in the state until the watermark has passed them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def on_rocks(df: DataFrame) -> DataFrame:
    """Let the session's stateful queries keep their state in RocksDB, as processors of one's own need it."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return df


class _Numbered(StatefulProcessor):
    """Per run: waiting events in a list, and the last number. Columns come as `at_micros` (microseconds) and the log's own."""

    def __init__(self, columns: list[str], kinds: StructType, key: str):
        self.columns, self.kinds, self.key = columns, kinds, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.kinds)
        self.last = handle.getValueState("last", "seq long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        self.last.update((int(initialState["seq"].iloc[0]),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            held = pdf[self.columns].astype(object).where(pdf[self.columns].notna(), None)
            self.waiting.appendList(list(held.itertuples(index=False, name=None)))
            for at in {-(-int(at) // 1000) for at in pdf["at_micros"]}:
                self.handle.registerTimer(at)
        yield pd.DataFrame(columns=[*self.columns, "seq"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        name = self.columns.index(self.key)
        due = sorted((r for r in rows if r[0] <= passed), key=lambda r: (r[0], r[name]))
        if not due:  # another timer of this batch gave them out
            yield pd.DataFrame(columns=[*self.columns, "seq"])
            return
        rest = [r for r in rows if r[0] > passed]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        first = self.last.get()[0] if self.last.exists() else 0
        self.last.update((first + len(due),))
        out = pd.DataFrame(due, columns=self.columns)
        yield out.assign(seq=range(first + 1, first + len(due) + 1))

    def close(self) -> None:
        pass


def numbered(log: DataFrame, run: str = "run_id", ts: str = "ts", key: str = "event_id", late: str = "30 minutes", stored: DataFrame | None = None) -> DataFrame:
    """The stream's events with `seq`, their number in their run by (ts, key), once the watermark (`late` behind the newest event) has
    passed them; what comes later than that is left out. Numbers go on from those of `stored` (run, seq), a table of each
    run's last one, so a new query doesn't collide with what an old one wrote."""
    log = on_rocks(log)
    own = [c for c in log.columns if c != ts]
    held = log.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("at_micros"), *own, F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, late)
    kinds = StructType([f for f in held.schema if f.name != ts])
    columns = [f.name for f in kinds]
    out = StructType([*kinds, StructField("seq", kinds["at_micros"].dataType)])
    # The time is made again from the microseconds, so the state holds plain columns.
    initial: GroupedData | None = None if stored is None else stored.select(F.col(run), F.col("seq").cast("long").alias("seq")).groupBy(run)
    got = held.groupBy(run).transformWithStateInPandas(_Numbered(columns, kinds, key), out, "append", "eventTime", initialState=initial)
    return got.withColumn(ts, F.timestamp_micros("at_micros")).select(*own, ts, "seq")


class _Folded(StatefulProcessor):
    """Per item: each field's last value with its place (microseconds, number of the event), attempts and events."""

    def __init__(self, item: str, fields: list[str], kinds: StructType, key: str | None):
        self.item, self.fields, self.kinds, self.key = item, fields, kinds, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("item", self.kinds)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = len(self.fields)
        held = list(self.state.get()) if self.state.exists() else [None] * (3 * n) + [0, 0]
        for pdf in rows:
            places = list(zip(pdf["at_micros"].tolist(), pdf[self.key].tolist() if self.key else [0] * len(pdf), strict=True))
            for i, field in enumerate(self.fields):
                for place, value in zip(places, pdf[field].tolist(), strict=True):
                    if not pd.isna(value) and (held[3 * i] is None or place >= (held[3 * i], held[3 * i + 1])):
                        held[3 * i : 3 * i + 3] = [*place, value]
            held[-2] += int(pdf["bump"].fillna(False).astype(bool).sum())
            held[-1] += len(pdf)
        self.state.update(tuple(held))
        yield pd.DataFrame({self.item: [key[0]]} | {f: [held[3 * i + 2]] for i, f in enumerate(self.fields)} | {"attempt": [held[-2]], "seq": [held[-1]]})

    def close(self) -> None:
        pass


def folded(log: DataFrame, item: str = "item", fields: tuple[str, ...] = ("status", "score", "error_text"), ts: str = "ts", key: str | None = "event_id") -> DataFrame:
    """Each item's state after each micro-batch: (item, fields, attempt, seq). A field keeps its last value that isn't null by (ts, key),
    whenever that came; bumps are attempts; seq counts the item's events. Without a key the one that comes later counts."""
    log = on_rocks(log)
    held = log.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("at_micros"), item, *fields, "bump", *([key] if key else []))
    kind = held.schema
    long = kind["at_micros"].dataType
    places = [f for name in fields for f in (StructField(f"{name}_at", long), StructField(f"{name}_key", kind[key].dataType if key else long), StructField(name, kind[name].dataType))]
    counts = [StructField("attempt", long), StructField("seq", long)]
    out = StructType([kind[item], *(kind[f] for f in fields), *counts])
    return held.groupBy(item).transformWithStateInPandas(_Folded(item, list(fields), StructType([*places, *counts]), key), out, "update", "none")
