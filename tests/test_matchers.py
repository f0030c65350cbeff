"""Matchers against the dictionary's own spans, and the two ways to resolve overlaps."""

import random

from pyspark.sql import functions as F

from maskloom.operators import masking, matchers
from maskloom.sources import dictionary as D

WHOLE = D.parse_dictionary("A: [new york, york city]\nN:\n  patterns: ['[0-9]+', 'york [0-9]+']")


def _texts(spark, n=200):
    rng = random.Random(6)
    parts = ["New York", "york", "city", "12", " ", " ", "7", "\\", "<A_1A>", "é", "­"]
    rows = [(k, None if k % 40 == 0 else "".join(rng.choices(parts, k=rng.randint(0, 14)))) for k in range(n)]
    return spark.createDataFrame(rows, "k long, t string")


def test_parts_of_a_dictionary_give_what_it_gives(spark):
    """Terms and each pattern as matchers of their own."""
    parts = [matchers.of_dictionary(D.Dictionary(terms=WHOLE.terms)), matchers.of_pattern("N", "[0-9]+"), matchers.of_pattern("N", "york [0-9]+")]
    df = _texts(spark)
    want = masking.find_spans(df, "t", WHOLE)
    got = want.withColumn("got", matchers.resolved(*(m(F.col("t")) for m in parts)))
    assert got.filter("NOT (got <=> spans)").isEmpty() and got.filter("size(got) > 2").count() > 20
    for escape in (False, True):
        columns = ["k", "masked", "entries", "max_group", "hits"]
        one, other = masking.mask(df, "t", WHOLE, escape=escape), matchers.mask(df, "t", parts, escape=escape)
        assert sorted(map(str, one.select(columns).collect())) == sorted(map(str, other.select(columns).collect()))


def test_a_matcher_of_columns(spark):
    """A third matcher that is no Python: the first word, by a column expression."""
    first = lambda t: F.when(t.rlike("^[a-z]+ "), F.array(F.struct(F.lit(0).alias("start"), F.length(F.regexp_extract(t, "^[a-z]+", 0)).alias("end"), F.lit("FIRST").alias("entity"), F.regexp_extract(t, "^[a-z]+", 0).alias("surface"), F.lit(None).cast("string").alias("suffix"))))
    df = spark.createDataFrame([("new york 5",), ("york city",), ("5 york",), (None,)], "t string")
    got = [r.masked for r in matchers.mask(df, "t", [matchers.of_dictionary(WHOLE), first]).collect()]
    # where both start at one place the longer one stays
    assert got == ["<A_1A> <N_1A>", "<A_2A>", "<N_1A> york", None]


def test_rows_are_resolved_as_arrays_are(spark, monkeypatch):
    rng, rows = random.Random(1), []
    for k in [None, *range(40)]:
        for _ in range(rng.randint(0, 30)):
            start = rng.randint(0, 40)
            rows.append((k, start, start + rng.randint(0, 6), rng.randint(0, 2), f"e{rng.randint(0, 1)}"))
    rows += [(1, None, 5, 0, "x"), (1, 3, None, 0, "x")]
    df = spark.createDataFrame(rows, "k long, start int, end int, rank int, entity string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # texts go over several batches
    try:
        got = sorted(map(str, matchers.resolved_rows(df, "k").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k and r[1] is not None and r[2] is not None), key=lambda r: r[4])
        want += [(k, a, b, rank, e) for a, b, rank, e in matchers._chosen([r[1:] for r in mine])]
    assert got == sorted(str(spark_row) for spark_row in spark.createDataFrame(want, df.schema).collect())
    assert matchers.resolved_rows(df.limit(0), "k").collect() == []
