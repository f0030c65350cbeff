"""The typed walk against the walk over JSON text."""

import json
import random

import pytest
from pyspark.sql import functions as F

from maskloom.operators import jsonwalk, masking, typedwalk
from maskloom.sources import dictionary as D

WORDS = D.parse_dictionary("W:\n  patterns: ['[a-z]{3,}']\nT: [Acme Corp]")
BLOCK = "struct<type:string,text:string,id:string,source:struct<data:string,note:string>,parts:array<array<string>>>"
BODY = f"struct<model:string,system:string,messages:array<struct<role:string,content:array<{BLOCK}>,n:int>>,tools:map<string,array<string>>,flag:boolean,last:string>"


def _value(rng, depth=0):
    word = lambda: None if rng.random() < 0.1 else " ".join(rng.choices(["abc", "defg", "ACME corp", "x", "<W_1A>", "é"], k=rng.randint(0, 3)))
    some = lambda make, most: None if rng.random() < 0.1 else [make() for _ in range(rng.randint(0, most))]
    source = lambda: None if rng.random() < 0.3 else {"data": word(), "note": word()}
    block = lambda: None if rng.random() < 0.1 else {"type": "abc", "text": word(), "id": word(), "source": source(), "parts": some(lambda: some(word, 2), 2)}
    message = lambda: None if rng.random() < 0.1 else {"role": "abc", "content": some(block, 3), "n": 1}
    tools = None if rng.random() < 0.2 else {k: some(word, 2) for k in rng.sample(["call_id", "some", "type", "more"], rng.randint(0, 4))}
    return {"model": "abc", "system": word(), "messages": some(message, 4), "tools": tools, "flag": True, "last": word()}


@pytest.mark.parametrize("dialect", ["openai", "anthropic"])
def test_same_rows_as_the_walk_over_text(spark, dialect):
    rng = random.Random(5)
    rows = [(k, json.dumps(_value(rng))) for k in range(120)]
    df = spark.createDataFrame(rows, "k int, t string").select("k", F.from_json("t", BODY).alias("body"))
    df = df.unionByName(df.limit(1).select(F.lit(None).cast("int").alias("k"), F.lit(None).cast(BODY).alias("body")))
    one = {"ignoreNullFields": "false"}
    typed = typedwalk.mask_typed(df, WORDS, "body", dialect=dialect)
    got = {r.k: (r.j, r.entries, r.hits) for r in typed.select("k", F.to_json("body", one).alias("j"), "entries", "hits").collect()}
    bodies = df.select("k", F.to_json("body", one).alias("body"), F.lit(dialect).alias("dialect"))
    walked = masking.mask_strings(bodies.withColumn("strings", jsonwalk.json_strings("body", "dialect")), "strings", WORDS)
    want = {r.k: r for r in jsonwalk.put_back(walked, "masked", "masked_body").collect()}
    assert got.pop(None) == (None, [], {})
    texts = {r.k: r.s for r in bodies.select("k", jsonwalk.json_strings("body", "dialect").alias("s")).collect()}
    slots = {r.k: [s for s in r.s if s is not None] for r in df.select("k", typedwalk.typed_strings(df, "body", dialect=dialect).alias("s")).collect()}
    for k, (masked, entries, hits) in got.items():
        assert slots[k] == texts[k]
        assert (entries, hits) == (want[k].entries, want[k].hits)
        assert json.loads(masked) == json.loads(want[k].masked_body), k
    assert sum(bool(entries) for _, entries, _ in got.values()) > 60
    back = typedwalk.restore_typed(typed, "entries", "body", dialect=dialect).select("k", F.to_json("body", one).alias("j"))
    first = {r.k: r.body for r in bodies.collect()}
    same = [r.j == first[r.k] for r in back.collect() if r.k is not None and "ACME" not in first[r.k]]
    assert len(same) > 3


def test_running_sums(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        values = [k % 5 for k in range(n)]
        got = spark.createDataFrame([(values,)], "v array<int>").select(typedwalk.sums_before(F.col("v")).alias("s")).first().s
        assert got == [sum(values[:k]) for k in range(n)]
    assert spark.sql("select cast(null as array<int>) v").select(typedwalk.sums_before(F.col("v"))).first()[0] in (None, [])


def test_what_is_refused(spark):
    for schema in ("f struct<arguments:string>", "v variant", "entries array<string>"):
        with pytest.raises(ValueError):
            typedwalk.mask_typed(spark.createDataFrame([], schema), WORDS)
    df = spark.sql("select map('arguments', '{}') as m")
    with pytest.raises(Exception, match="arguments"):
        typedwalk.mask_typed(df, WORDS).collect()
    plain = spark.sql("select 1 as a, 'abc' as role")
    assert typedwalk.mask_typed(plain, WORDS).select("a", "role").first() == (1, "abc")
