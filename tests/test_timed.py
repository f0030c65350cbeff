"""Timed state: against the batch limiter, over a restart, and after expiry."""

import os
import time
from datetime import datetime

import pytest

from maskloom.operators import observe
from maskloom.streaming import timed

EVENTS = "event_id long, user string, ts timestamp"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(timed.STATE_STORE[0], None)
    timed.use_rocksdb(spark)
    yield spark
    if before is None:
        spark.conf.unset(timed.STATE_STORE[0])
    else:
        spark.conf.set(timed.STATE_STORE[0], before)


def _put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def _run(df, folder):
    return df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(processingTime="1 second").start()


def _told(spark, folder, schema="user string, event_id long, admitted boolean"):
    """The rows told so far."""
    return spark.read.schema(schema).parquet(f"{folder}/out").collect() if os.path.isdir(f"{folder}/out/_spark_metadata") else []


def _once(spark, df, folder, n):
    """A query that runs until n rows are told. It never finds that all is processed, as it also runs for time alone."""
    query = _run(df, folder)
    try:
        assert _until(60, lambda: len(_told(spark, folder)) >= n), query.exception() or query.lastProgress
    finally:
        query.stop()


def _until(seconds, test):
    end = time.time() + seconds
    while time.time() < end:
        if test():
            return True
        time.sleep(0.5)
    return False


def test_limiter_goes_on_after_a_restart(rocksdb, tmp_path):
    spark, rows = rocksdb, [(k, f"u{k % 3}", k * 0.07) for k in range(90)] + [(90, "u0", None)]
    rows = [(k, u, None if t is None else datetime.fromtimestamp(1_700_000_000 + t)) for k, u, t in rows]
    source = f"{tmp_path}/in"
    want = {r.event_id: r.admitted for r in observe.rate_limited(spark.createDataFrame(rows, EVENTS), "user", "ts", 1000, 3).collect()}
    assert set(want.values()) == {True, False}
    for part, n in ((rows[:40], 40), (rows[40:], 91)):  # the second part is read by a new query with the same checkpoint
        _put(spark, part, EVENTS, source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        _once(spark, timed.limited_stream(stream, "user", "ts", 1000, 3, idle_ms=600_000), tmp_path, n)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.columns == ["user", "event_id", "admitted"]
    assert {r.event_id: r.admitted for r in got.collect()} == want


def test_limiter_forgets_idle_keys(rocksdb, tmp_path):
    spark, when = rocksdb, datetime(2024, 1, 1)
    source = f"{tmp_path}/in"
    for k in range(3):
        _put(spark, [(k, "u", when)], EVENTS, source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        _once(spark, timed.limited_stream(stream, "user", "ts", 3_600_000, 1, idle_ms=15_000), tmp_path, k + 1)
        if k == 1:
            time.sleep(16)  # the state is gone then, so the third one is admitted though the window is an hour
    got = {r.event_id: r.admitted for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: True, 1: False, 2: True}


def test_bypass_ends_by_itself(rocksdb, tmp_path):
    spark, schema = rocksdb, "event_id long, service string, minutes int"
    source = f"{tmp_path}/in"
    kinds = lambda: sorted((r.event_id is None, r.event_id or 0, r.service, r.kind) for r in _told(spark, tmp_path, "service string, event_id long, kind string"))
    _put(spark, [(1, "a", None), (2, "a", 5), (3, "a", None), (4, "b", None), (5, "b", 1441), (6, "c", 9), (7, "c", 0), (8, "c", None)], schema, source)
    query = _run(timed.bypassed_stream(spark.readStream.schema(schema).parquet(source), "service", minute_ms=2000), tmp_path)
    try:
        first = [(False, 1, "a", "masked"), (False, 2, "a", "set"), (False, 3, "a", "bypassed"), (False, 4, "b", "masked"), (False, 5, "b", "refused"), (False, 6, "c", "set"), (False, 7, "c", "cleared"), (False, 8, "c", "masked")]
        assert _until(60, lambda: len(kinds()) >= 8) and kinds()[:8] == first
        # without any event the timer ends the window of a
        assert _until(60, lambda: kinds()[8:] == [(True, 0, "a", "expired")])
        _put(spark, [(9, "a", None)], schema, source)
        assert _until(60, lambda: (False, 9, "a", "masked") in kinds())
    finally:
        query.stop()
