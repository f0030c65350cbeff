"""Activity, rate limit, bypass windows and the guard of log records."""

from __future__ import annotations

from collections import deque
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.operators import masking
from maskloom.sources.dictionary import Dictionary

# Kept events, minutes of a bypass, limiter defaults.
RING, MAX_BYPASS_MINUTES, WINDOW_MS, PER_WINDOW = 200, 1440, 1000, 60
BLOCKED = "[BLOCKED: log record held a protected term]"


def last_events(events: DataFrame, limit: int = 50, order: str = "seq") -> DataFrame:
    """The newest events, at most RING of them, newest first."""
    return events.orderBy(F.desc(order)).limit(max(1, min(limit, RING)))


def activity(masked: DataFrame, *keys: str) -> DataFrame:
    """Counts only: for each key and entity the documents with hits, the hits and the highest token number."""
    rows = masked.select(*keys, F.explode_outer("hits").alias("entity", "n"), "max_group").filter("entity IS NOT NULL").withColumn("top", F.element_at("max_group", F.col("entity")))
    return rows.groupBy(*keys, "entity").agg(F.count("*").alias("documents"), F.sum("n").alias("hits"), F.max("top").alias("max_group"))


def bypassed(events: DataFrame, windows: DataFrame, ts: str = "ts") -> DataFrame:
    """events with bypassed: whether a window (from_ts, minutes) covers the time, its end excluded.

    Windows are cut into the hours that they touch, so the range join is one on equal hours."""
    good = windows.filter(F.col("minutes").between(1, MAX_BYPASS_MINUTES)).withColumn("until_ts", F.expr("from_ts + make_interval(0, 0, 0, 0, 0, minutes, 0)"))
    hours = good.select("from_ts", "until_ts", F.explode(F.expr("sequence(date_trunc('HOUR', from_ts), date_trunc('HOUR', until_ts), interval 1 hour)")).alias("hour")).distinct()
    rows = events.withColumn("__hour", F.date_trunc("HOUR", ts))
    by_hour = hours.groupBy("hour").agg(F.collect_set(F.struct("from_ts", "until_ts")).alias("__windows"))
    rows = rows.join(by_hour, rows["__hour"] == by_hour["hour"], "left")
    inside = F.exists("__windows", lambda w: (F.col(ts) >= w["from_ts"]) & (F.col(ts) < w["until_ts"]))
    return rows.withColumn("bypassed", F.coalesce(inside, F.lit(False))).drop("__hour", "hour", "__windows")


def _admitting(window_ms: int, most: int):
    """Sorted batches (key, event_id, ms) to (key, event_id, admitted). Of the key at hand only the times of the
    last `most` admitted events are kept."""

    def admit(batches):
        last, kept = (), deque(maxlen=max(most, 0))
        for batch in batches:
            out = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if last != (key,):
                    last, kept = (key,), deque(maxlen=max(most, 0))
                ok = most > 0 and (t is None or len(kept) < most or t - kept[0] >= window_ms)
                out.append(ok)
                if ok and t is not None:
                    kept.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=[batch.schema.names[0], "event_id", "admitted"])

    return admit


def rate_limited(events: DataFrame, key: str, ts: str, window_ms: int = WINDOW_MS, most: int = PER_WINDOW) -> DataFrame:
    """key, event_id and admitted of events, by the sliding window of each key: an event is admitted unless `most`
    admitted ones are less than window_ms old; rejected ones don't count, nor does one without a time.

    A key's events pass one after the other, in a sorted partition; they are never gathered, but the time of a very busy
    key is not split, since each decision rests on the one before."""
    rows = events.select(key, "event_id", F.unix_millis(F.col(ts).cast("timestamp")).alias("__ms"))
    rows = rows.repartition(key).sortWithinPartitions(key, "__ms", "event_id")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields[:2]] + [T.StructField("admitted", T.BooleanType())])
    return rows.mapInArrow(_admitting(window_ms, most), schema)


def log_guard(message: Column, dictionary: Dictionary) -> Column:
    """The message, or a note in its place if it holds a term in any case; strictness and patterns don't count."""
    finder = masking.Finder(Dictionary(terms=[replace(t, strict=False) for t in dictionary.terms]))

    @F.arrow_udf("boolean")
    def held(messages: pa.Array) -> pa.Array:
        return pa.array([bool(finder(m)) for m in messages.to_pylist()], pa.bool_())

    return F.when(held(message), F.lit(BLOCKED)).otherwise(message)


def forbidden_strings(files: DataFrame, text: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """files with found: the names of the patterns (name, pattern) that a text holds."""
    names = [F.when(F.col(text).rlike(p), F.lit(n)) for n, p in patterns]
    return files.withColumn("found", F.array_compact(F.array(*names)))
