"""Sessions of many rows against one session that sees all texts in order."""

import random

import pytest
from pyspark.sql import functions as F

from maskloom.functions import text as X
from maskloom.operators import masking, sessions
from maskloom.sources import dictionary as D

# an entity of terms and patterns, whose numbers meet; aliases; two spellings of one term
MIXED = D.parse_dictionary(
    """
A:
  terms: ['new york, york, the apple', 'rome', 'oslo', 'bonn, bn']
  patterns: ['[0-9]+', 'x[a-z]']
N:
  patterns: ['n[0-9]+']
"""
)
WORDS = ["new york", "New  York", "NEW\tYORK", "york", "the apple", "Rome", "oslo", "bonn", "BN", "1", "2", "33", "xa", "xB", "XA", "n1", "n2", "word", "\\rome", "\\7", "<A_1A>", "­"]


def plain(rows, token_format=masking.TOKEN_FORMAT, escape=False):
    """Masked texts and mapping entries, one session after the other."""
    find, masked, entries = masking.Finder(MIXED), {}, set()
    for key in {r[0] for r in rows}:
        session = masking._Session(token_format, escape)
        for _, order, text, clean in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            masked[key, order] = session.masked(clean, find(clean)) if text is not None else None
        entries |= {(key, t, e, s) for t, (e, s) in session.by_token.items()}
    return masked, entries


@pytest.mark.parametrize("seed, escape, token_format", [(1, False, "<{type}_{n}>"), (2, True, "<{type}_{n}>"), (3, True, "[{type}/{n}]")])
def test_against_one_session(spark, seed, escape, token_format):
    rng = random.Random(seed)
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6, 7]), k, None if rng.random() < 0.05 else " ".join(rng.choices(WORDS, k=rng.randint(0, 6)))) for k in range(260)]
    df = spark.createDataFrame(rows, "s long, o long, t string")
    clean = {r.o: r.c for r in df.select("o", X.escape_look_alikes(X.sanitized(F.col("t"))).alias("c")).collect()}
    got, mapping = sessions.mask_sessions(df.withColumn("masked", F.lit(1)).repartition(5), "t", "s", "o", MIXED, token_format, escape)
    masked, entries = plain([(s, o, t, clean[o]) for s, o, t in rows], token_format, escape)
    assert {(r.s, r.o): r.masked for r in got.collect()} == masked
    assert {tuple(r) for r in mapping.collect()} == entries
    groups = {(r.s, r.entity): r.max_group for r in sessions.max_groups(mapping, "s", token_format).collect()}
    numbers = lambda s, e: [int("".join(filter(str.isdigit, t.replace(e, "", 1)))) for k, t, x, _ in entries if (k, x) == (s, e)]
    assert groups == {(s, e): max(numbers(s, e)) for s, _, e, _ in entries}
    back = sessions.restore_sessions(got, "masked", "s", mapping, token_format).collect()
    for r in back:
        if r.t is None:
            assert r.restored_text is None and r.restored == 0
        else:
            assert r.restored_text.lower().replace("\\", "") == r.t.replace("­", "").lower().replace("\\", "")


def test_a_session_of_many_ranges(spark):
    """100,000 rows of one session, in many ranges: numbers follow each other across them, none is given twice."""
    rows = spark.range(0, 100_000, 1, 16).selectExpr("1L AS s", "99999 - id AS o", "concat('n', id % 30000, IF(id % 1000 = 7, ' rome 5', '')) AS t")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got, mapping = sessions.mask_sessions(rows, "t", "s", "o", MIXED)
        n = mapping.filter("entity = 'N'").agg(F.count("*"), F.count_distinct("token"), F.max(F.expr("int(substring(token, 4, length(token) - 5))"))).first()
        assert tuple(n) == (30_000, 30_000, 30_000)
        # the first one in order is that of the last id
        assert got.filter("o = 0").first().masked == "<N_1A>" and got.filter("o = 29999").first().masked == "<N_30000A>"
        # rome brings 2 and comes first, so 5 takes 3
        assert {r.token for r in mapping.filter("entity = 'A'").collect()} == {"<A_2A>", "<A_3A>"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_edges(spark):
    empty = spark.createDataFrame([], "s string, o int, t string")
    got, mapping = sessions.mask_sessions(empty, "t", "s", "o", MIXED)
    assert got.collect() == [] and mapping.collect() == []
    rows = spark.createDataFrame([("a", None, "2 rome"), ("a", 1, "rome 3"), ("a", 1, "rome 3"), (None, 1, "3")], "s string, o int, t string").selectExpr("*", "1 AS entity", "2 AS token", "3 AS key")
    got, mapping = sessions.mask_sessions(rows, "t", "s", "o", MIXED)
    # 2 takes the first number; rome brings 2, which lifts the counter, so 3 takes the third
    assert sorted((str(r.s), str(r.o), r.masked) for r in got.collect()) == [("None", "1", "<A_1A>"), ("a", "1", "<A_2A> <A_3A>"), ("a", "1", "<A_2A> <A_3A>"), ("a", "None", "<A_1A> <A_2A>")]
    back = sessions.restore_sessions(got, "masked", "s", mapping).collect()
    assert sorted(r.restored_text for r in back) == ["2 rome", "3", "rome 3", "rome 3"] and {r.restored for r in back} == {1, 2}
