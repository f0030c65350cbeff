"""The rate limit of one busy key."""

import random

from pyspark.sql import functions as F

from maskloom.operators import observe


def test_a_busy_key_is_not_gathered(spark):
    rnd = random.Random(4)
    rows = [(7 if rnd.random() < 0.9 else rnd.randrange(5), k, rnd.randrange(60_000)) for k in range(3000)] + [(None, 3000, 5), (7, 3001, None)]
    want, kept = {}, {}
    for user, k, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        young = [x for x in kept.get(user, []) if t - x < 1000]
        want[k] = len(young) < 3
        kept[user] = young + [t] * want[k]
    want[3001] = True
    events = spark.createDataFrame(rows, "user_id long, event_id long, ms long").select("user_id", "event_id", F.timestamp_millis("ms").alias("ts"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # a key goes on in the next batch
    try:
        limited = observe.rate_limited(events, "user_id", "ts", window_ms=1000, most=3)
        assert {r.event_id: r.admitted for r in limited.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "collect_list" not in limited._jdf.queryExecution().optimizedPlan().toString()
