"""Catalog queries against their SQL, streaming and JSON edges."""

import duckdb
import pytest

from maskloom.operators import jsonwalk
from maskloom.plans import catalog
from maskloom.streaming import restoring

SF = "/root/testdata/sf0.001"
VECTORS, VECTOR_SQL = catalog.vectors()
QUERIES, SQL = catalog.queries() | VECTORS, catalog.oracle_sql() | VECTOR_SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer orders lineitem documents benchmark pages conversations events".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)


def test_every_cut_gives_the_same_text():
    mapping = {"<A_1A>": "x", "<LONG_NAME_12B>": "y"}
    text = "a <A_1A><<B_2>> <LONG_NAME_12B> < <A <Z_9A> <<A_1A>>"
    for n in range(1, len(text) + 1):
        one = restoring.Restorer(mapping)
        assert "".join(one.feed(text[k : k + n]) for k in range(0, len(text), n)) + one.end() == restoring.restored(text, mapping), n


def test_events_hold_and_drain():
    one = restoring.EventRestorer({"<COMPANY_1A>": "ACME"})
    parts = ["<COM", "PANY", "_1A> and <"]
    out = "".join(one.feed('data: {"d":"' + p + '"}\n\n') for p in parts) + one.feed("data: [DONE]\n\n", True)
    said = [line[6:] for line in out.split("\n") if line.startswith("data: ")]
    assert said == ['{"d":""}', '{"d":""}', '{"d":"ACME and <"}', "[DONE]"]


def test_json_limits():
    assert jsonwalk.strings_of("[" * 40 + "]" * 40, "openai") is None and jsonwalk.strings_of('{"prototype":1}', "openai") is None
    assert jsonwalk.dumps({"b": 2.0, "1": [1.5], "0": None}) == '{"0":null,"1":[1.5],"b":2}'
    assert jsonwalk.strings_of('{"arguments":"{bad"}', "openai") == ["{bad"]


def test_structured_streaming(spark, tmp_path):
    rows = [("s", k, p, k == 2) for k, p in enumerate(["x <A", "_1A> y", "!"])]
    schema = "stream_id string, seq long, chunk string, is_last boolean"
    for k, r in enumerate(rows):
        spark.createDataFrame([r], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = restoring.restore_stream(stream, {"<A_1A>": "term"}).writeStream.format("memory").queryName("restored").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [r.text for r in spark.table("restored").orderBy("seq").collect()]
    assert "".join(got) == "x term y!"


def test_finished_streams_over_several_batches(spark):
    text = "x <A_1A> and <<A_1A>> <A_"
    rows = [(s, k, text[k : k + 1], k == len(text) - 1) for s in (1, 2, None) for k in range(len(text))]
    df = spark.createDataFrame(rows[::-1], "stream_id long, seq long, chunk string, is_last boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = sorted(restoring.restore_streams(df, {"<A_1A>": "term"}).collect(), key=lambda r: r.seq)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {s: "".join(r.text for r in got if r.stream_id == s) for s in (1, 2, None)} == dict.fromkeys((1, 2, None), restoring.restored(text, {"<A_1A>": "term"}))
    assert restoring.restore_streams(df.limit(0), {}).collect() == []
