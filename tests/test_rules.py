"""Rules in a table against the rules of a dictionary."""

import random

from pyspark.sql import functions as F

from maskloom.operators import guard, rules
from maskloom.sources import dictionary as D

RULES = "rule long, category string, term string, strict boolean"


def _dictionary(rows):
    return D.Dictionary(terms=[D.Term(k, c, t, t, bool(s), False, "1A") for k, c, t, s in rows if t and t.strip()])


def test_equal_to_the_guard(spark):
    rng = random.Random(2)
    parts = ["new", "York", "K", "K", "ſ", "ß", "알파", "漢字", "é", "É", "x", "42", "-", "a b"]
    word = lambda n: "".join(rng.choice(parts) + rng.choice(["", "", " ", "  ", "\n", " "]) for _ in range(rng.randint(1, n)))
    table = [(k, rng.choice("AB"), word(3), rng.choice([True, False, None])) for k in range(150)] + [(900, "A", " ", False), (901, "B", None, None)]
    texts = [(k % 30, rng.choice([word(12), word(12).upper(), word(5) + rng.choice(table[:150])[2]])) for k in range(60)] + [(1, None), (2, "")]
    df = spark.createDataFrame(texts, "k long, t string")
    hits = rules.rule_hits(df.withColumn("category", F.lit(1)).repartition(3), "t", spark.createDataFrame(table + table[:5], RULES))
    assert hits.columns == ["k", "rule", "category"]
    got = sorted(map(tuple, hits.collect()))
    want = []
    for k, text in texts:
        for rule, category, term, strict in table[:150]:
            checker = guard._Rules(_dictionary([(0, category, term, strict)]))
            want += [(k, rule, category) for _ in checker.tripped(text or "")]
    assert got == sorted(want) and len(got) > 100
    counts = {(r.k, r.category): r.rules for r in rules.rule_counts(hits, "k").collect()}
    assert sum(counts.values()) == len(want)


def test_many_rules_and_a_plan_of_one_size(spark):
    """5,000 rules, of which few match; the pairs that are checked grow with the hits, not with rules times texts."""
    table = spark.range(5000).selectExpr("id AS rule", "concat('C', id % 3) AS category", "concat('Code ', lpad(id, 5, '0'), 'x') AS term", "false AS strict")
    texts = spark.range(2000).selectExpr("id AS k", "concat('see code  ', lpad(id * 2, 5, '0'), 'X and code 1') AS t")
    got = rules.rule_hits(texts, "t", table)
    assert got.count() == 2000 and got.filter("rule <> k * 2").isEmpty()
    assert len(rules.rule_counts(got, "k")._jdf.queryExecution().toString()) < 5000


def test_large_index_is_joined(spark, monkeypatch):
    monkeypatch.setattr(rules, "BROADCAST_ROWS", 0)
    table = spark.createDataFrame([(1, "A", "the end", None), (2, "A", "a", None), (3, "B", "zz", None)], RULES)
    texts = spark.createDataFrame([(k, "The\nEND" if k % 3 else "a then end") for k in range(300)], "k long, t string")
    assert sorted(map(tuple, rules.rule_hits(texts, "t", table).groupBy("rule").count().collect())) == [(1, 200), (2, 100)]


def test_edges(spark):
    none, some = spark.createDataFrame([], RULES), spark.createDataFrame([(1, "A", "x", None)], RULES)
    texts = spark.createDataFrame([(1, "x " * 300_000), (1, "x"), (1, "x")], "k long, t string")
    assert rules.rule_hits(texts, "t", none).collect() == []
    assert rules.rule_hits(texts.limit(0), "t", some).collect() == []
    assert rules.rule_hits(texts, "t", some).count() == 3
