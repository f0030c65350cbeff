"""Fallback chains without an active provider, and with several."""

from pyspark.sql import functions as F

from maskloom.functions import text as X
from maskloom.operators import gateway


def test_fallback_chain_of_any_active_providers(spark):
    requests = spark.createDataFrame([(1, None), (2, "a")], "request_id long, provider string")

    def chains(*active):
        providers = spark.createDataFrame([(n, n in active, 0 if n == "b" else None) for n in ("d", "c", "b", "a")], "name string, active boolean, fallback_pos int")
        return sorted(tuple(r) for r in gateway.fallback_chain(requests, providers).collect())

    assert chains() == [(1, 0, "b"), (2, 0, "a"), (2, 1, "b")]
    assert chains("d", "c") == [(1, 0, "c"), (1, 1, "b"), (2, 0, "a"), (2, 1, "b")]


def test_catalogue_endpoint(spark):
    kinds = [{"anthropic": "a", "openai": "o"}, {"anthropic": "a", "responses": "r", "openai": "o"}, {"anthropic": "a"}, {}, None]
    rows = spark.createDataFrame([(k, m) for k, m in enumerate(kinds)], "k int, endpoints map<string,string>")
    got = {r.k: r.at for r in rows.select("k", gateway.catalogue_endpoint(F.col("endpoints")).alias("at")).collect()}
    assert got == {0: "o", 1: "r", 2: "a", 3: None, 4: None}


def test_look_alikes_there_and_back(spark):
    texts = ["<X_1A>", "<<X_1A>>", "a < b <X_9>> <x_1A>", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(X.unescape_look_alikes(X.escape_look_alikes(F.col("t"))).alias("back")).collect()
    assert [r.back for r in got] == ["<X_1A>", "<X_1A>", "a < b <X_9>> <x_1A>", "", None]
