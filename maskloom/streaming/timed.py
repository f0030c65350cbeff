"""State that ends by itself: the limiter and the bypass window in Structured Streaming.

Both are stateful processors of transformWithState, keyed, with the state in RocksDB and in the query's
checkpoint, so a restarted query goes on where it was. What a key has left goes by time to live or by a
processing-time timer, not by a later event of the key; so the state is bounded by the keys of the last moments.
Queries have to run by a processingTime trigger: as time alone can end a state, an availableNow query has no end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskloom.operators.observe import MAX_BYPASS_MINUTES, PER_WINDOW, WINDOW_MS

#: What a session needs for these queries.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def use_rocksdb(spark: SparkSession) -> None:
    """Name the state store that timed state needs, for the queries that the session starts from now on."""
    spark.conf.set(*STATE_STORE)


def _long(value) -> int | None:
    return None if pd.isna(value) else int(value)


class Limiter(StatefulProcessor):
    """(event_id, ms) of a key to (key, event_id, admitted): an event is admitted unless `most` admitted ones of the key are
    less than window_ms older. State are the times of the last `most` admitted events; it ends idle_ms after the
    key's last admitted event."""

    def __init__(self, window_ms: int, most: int, idle_ms: int):
        self.window_ms, self.most, self.idle_ms = window_ms, most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "times array<bigint>", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(rows).sort_values(["ms", "event_id"], kind="stable", na_position="first")
        times, admitted = [int(t) for t in self.kept.get()[0]] if self.kept.exists() else [], []
        before = list(times)
        for ms in map(_long, events["ms"]):
            ok = self.most > 0 and (ms is None or len(times) < self.most or ms - times[0] >= self.window_ms)
            admitted.append(ok)
            if ok and ms is not None:
                times = [*times, ms][-self.most :]
        if times != before:
            self.kept.update((times,))
        yield pd.DataFrame({"key": key[0], "event_id": events["event_id"].to_numpy(), "admitted": admitted})

    def close(self) -> None:
        pass


class Bypass(StatefulProcessor):
    """(event_id, minutes) of a key to (key, event_id, kind). Rows with minutes are commands: 1 to MAX_BYPASS_MINUTES open
    the window from now on (set), 0 closes it (cleared), others are wrong (refused). Rows without are events: bypassed
    while the window is open, else masked. A window that ends by itself gives a row expired, without an event, at once."""

    def __init__(self, minute_ms: int):
        self.minute_ms = minute_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(rows).sort_values("event_id", kind="stable")
        now = timerValues.getCurrentProcessingTimeInMs()
        until = int(self.until.get()[0]) if self.until.exists() else 0
        kinds, was = [], until
        for minutes in map(_long, events["minutes"]):
            if minutes is None:
                kinds.append("bypassed" if now < until else "masked")
            elif 1 <= minutes <= MAX_BYPASS_MINUTES:
                until = now + minutes * self.minute_ms
                kinds.append("set")
            else:
                until = 0 if minutes == 0 else until
                kinds.append("cleared" if minutes == 0 else "refused")
        if until != was:
            if was:
                self.handle.deleteTimer(was)
            if until:
                self.until.update((until,))
                self.handle.registerTimer(until)
            else:
                self.until.clear()
        yield self._rows(key, events["event_id"].to_numpy(), kinds)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        yield self._rows(key, [None], ["expired"])

    @staticmethod
    def _rows(key, ids, kinds) -> pd.DataFrame:
        return pd.DataFrame({"key": key[0], "event_id": pd.array(ids, "Int64"), "kind": kinds})

    def close(self) -> None:
        pass


def limited_stream(events: DataFrame, key: str, ts: str, window_ms: int = WINDOW_MS, most: int = PER_WINDOW, idle_ms: int | None = None) -> DataFrame:
    """key, event_id, admitted of a stream of events, as observe.rate_limited() tells them where events come in order. The
    events of a batch are taken by time; one that comes in a later batch than a newer one is measured against
    what was admitted before it. An event without a time doesn't count. A key's state ends idle_ms (twice the window if null)
    of processing time after its last admitted event."""
    rows = events.select(F.col(key).alias("key"), "event_id", F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"))
    schema = T.StructType([rows.schema["key"], rows.schema["event_id"], T.StructField("admitted", T.BooleanType())])
    limiter = Limiter(window_ms, most, 2 * window_ms if idle_ms is None else idle_ms)
    out = rows.groupBy("key").transformWithStateInPandas(limiter, schema, "Append", "ProcessingTime")
    return out.withColumnRenamed("key", key)


def bypassed_stream(events: DataFrame, key: str, minute_ms: int = 60_000) -> DataFrame:
    """key, event_id, kind of a stream of events and commands(key, event_id, minutes), by processing time."""
    rows = events.select(F.col(key).alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("minutes").cast("long").alias("minutes"))
    schema = T.StructType([rows.schema["key"], T.StructField("event_id", T.LongType()), T.StructField("kind", T.StringType())])
    return rows.groupBy("key").transformWithStateInPandas(Bypass(minute_ms), schema, "Append", "ProcessingTime").withColumnRenamed("key", key)
