"""Queries of reports, providers, hooks and SQL functions over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import sql
from maskloom.functions import text as X
from maskloom.operators import gateway, masking, report
from maskloom.sources import dictionary as D
from maskloom.sources import providers
from maskloom.streaming import restoring

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(text: str):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = text
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LICENSES = D.parse_dictionary("LICENSE: ['MIT License, Apache License']")
PROVIDERS = providers.parse_providers("""
active: one
fallback: [two, three]
providers:
  one: {auth: passthrough, endpoints: {anthropic: 'https://one.example/'}}
  two: {auth: api_key, api_key_env: TWO_KEY, endpoints: {openai: 'https://two.example//'}}
  three: {endpoints: {openai: 'https://three.example', anthropic: 'https://three.example/a'}}
  four: {endpoints: {responses: 'https://four.example'}}
""")
_HITS = r"len(regexp_extract_all(text, '(?i)\b(MIT|Apache) License\b'))"


@_query(rf"SELECT doc_id, CAST({_HITS} AS BIGINT) AS spans, false AS leak, CAST(0 AS BIGINT) AS n_leaks, true AS lossless, CAST(coalesce(strpos(lower(text), 'mit license'), 0) AS BIGINT) AS first_mit FROM documents")
def q_inspect_documents(spark, sf_dir):
    rows = report.inspected(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", LICENSES)
    first = F.array_min(F.transform(F.filter("found", lambda s: F.lower(s["surface"]) == "mit license"), lambda s: s["start"])) + 1
    return rows.select("doc_id", F.size("found").cast("long").alias("spans"), "leak", "n_leaks", "lossless", F.coalesce(first, F.lit(0)).cast("long").alias("first_mit"))


@_query(r"SELECT doc_id, regexp_replace(text, '(?i)Apache License', 'MIT License', 'g') AS plain FROM documents")
def q_normalized_aliases(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", report.normalized_aliases(F.col("text"), LICENSES).alias("plain"))


@_query(
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '(?i)\bMIT License\b') AS m, regexp_extract_all(text, '(?i)\bApache License\b') AS a FROM documents)
  SELECT doc_id, CAST(len(m) + len(a) AS BIGINT) AS restored, CASE WHEN len(m) > 0 AND len(a) > 0 THEN '<LICENSE_1A>,<LICENSE_1B>' WHEN len(m) > 0 THEN '<LICENSE_1A>' WHEN len(a) > 0 THEN '<LICENSE_1B>' ELSE '' END AS tokens FROM t"""
)
def q_restored_segments(spark, sf_dir):
    rows = masking.mask(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", LICENSES)
    parts = report.restored_segments(F.col("masked"), F.col("entries"))
    n = F.size(F.filter(parts, lambda s: s["restored"])).cast("long")
    return rows.select("doc_id", n.alias("restored"), F.array_join(report.mapping_tokens(F.col("entries")), ",").alias("tokens"))


@_query(r"""WITH t AS (SELECT lang, unnest(regexp_extract_all(text, '(?i)\b(?:MIT|Apache) License\b')) AS s FROM documents) SELECT lang, CAST(count(DISTINCT s) AS BIGINT) AS surfaces FROM t GROUP BY lang""")
def q_bypassed_surfaces(spark, sf_dir):
    marked = F.regexp_replace("text", "(?i)((?:MIT|Apache) License)", r"\\$1")
    rows = masking.mask(_table(spark, sf_dir, "documents").select("lang", marked.alias("text")), "text", LICENSES, escape=True)
    return report.bypassed_distinct(rows, "lang")


@_query(
    """SELECT CAST(2 AS BIGINT) AS terms, CAST(0 AS BIGINT) AS strict, CAST(0 AS BIGINT) AS patterns, max(ts) >= TIMESTAMP '2024-01-01 12:00:00' AS bypassed, CAST(count(*) AS BIGINT) AS events,
  CAST(sum(event_id % 3) AS BIGINT) AS masked, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS tripped FROM events"""
)
def q_status(spark, sf_dir):
    """The totals of an activity feed, with a bypass window that is open at its end."""
    events = _table(spark, sf_dir, "events")
    feed = events.select(F.create_map(F.lit("A"), (F.col("event_id") % 3).cast("int")).alias("masked"), (F.col("event_type") == "error").alias("guard_tripped"))
    windows = events.agg(F.max("ts").cast("timestamp").alias("m")).select((F.col("m") - F.expr("interval 1 hour")).alias("from_ts"), F.lit(90).alias("minutes"), "m")
    row = report.status(feed, LICENSES, windows.select("from_ts", "minutes"), F.lit(windows.first()["m"]))
    return row.drop("bypass_until")


@_query(
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'https://one.example' WHEN 1 THEN 'https://two.example' WHEN 2 THEN CASE WHEN c_custkey % 2 = 0 THEN 'https://three.example/a' ELSE 'https://three.example' END END AS endpoint,
  CASE c_custkey % 5 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' WHEN 2 THEN CASE WHEN c_custkey % 2 = 0 THEN 'anthropic' ELSE 'openai' END END AS upstream_dialect,
  CAST(CASE c_custkey % 5 WHEN 3 THEN 502 WHEN 4 THEN 404 ELSE 200 END AS BIGINT) AS status FROM customer"""
)
def q_resolved_endpoints(spark, sf_dir):
    k = F.col("c_custkey")
    names = F.array(*map(F.lit, ("one", "two", "three", "four", "five")))
    requests = _table(spark, sf_dir, "customer").select("c_custkey", F.get(names, (k % 5).cast("int")).alias("provider"), F.when(k % 2 == 0, "anthropic").otherwise("openai").alias("dialect"))
    return gateway.resolved(requests, PROVIDERS.relation(spark)).select("c_custkey", "endpoint", "upstream_dialect", F.col("status").cast("long").alias("status"))


@_query("SELECT * FROM (VALUES ('anthropic', 0, 'three', 'https://three.example/a'), ('openai', 0, 'two', 'https://two.example'), ('openai', 1, 'three', 'https://three.example')) t(dialect, pos, name, endpoint)")
def q_fallbacks_of_dialect(spark, sf_dir):
    rows = PROVIDERS.relation(spark)
    return gateway.fallbacks_of_dialect(rows, "anthropic").withColumn("dialect", F.lit("anthropic")).union(gateway.fallbacks_of_dialect(rows, "openai").withColumn("dialect", F.lit("openai")))


@_query(
    """SELECT event_id, CAST(CASE WHEN event_id % 7 = 0 THEN 405 WHEN event_id % 3 = 0 THEN 403 WHEN event_id % 5 = 0 THEN 403 ELSE 200 END AS BIGINT) AS hook,
  CAST(CASE WHEN event_id % 4 = 0 THEN 502 ELSE 200 END AS BIGINT) AS answer, event_id % 2 = 0 AS admin FROM events"""
)
def q_hooks_of_events(spark, sf_dir):
    k = F.col("event_id")
    origin = F.when(k % 3 == 0, "https://Elsewhere.example").when(k % 3 == 1, "http://LOCALHOST:8080")
    host = F.when(k % 5 == 0, "other.example:1").otherwise("127.0.0.9:80")
    secret = "5e884898da28047151d0e56f8dc6292773603d0d6aabbdd62a11ef721d1542d8"  # of "password"
    length = F.create_map(F.lit("Content-Length"), F.when(k % 4 == 0, "33554433").otherwise("33554432"))
    return _table(spark, sf_dir, "events").select(
        "event_id",
        gateway.hook_status(F.when(k % 7 == 0, "trace").otherwise("POST"), origin, host).cast("long").alias("hook"),
        gateway.response_status(F.lit(200), length).cast("long").alias("answer"),
        gateway.admin_allowed(F.when(k % 2 == 0, "password").otherwise("passwort"), secret).alias("admin"),
    )


@_query("SELECT doc_id, CAST(least(length(text), 100) AS INT) AS most, true AS whole FROM documents")
def q_bounded_texts(spark, sf_dir):
    """Beginnings of 100 bytes: whole characters, and no shorter than has to be."""
    head = gateway.bounded_text(F.col("text"), 100)
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text", head.alias("head"))
    whole = F.col("text").startswith(F.col("head")) & ((F.col("head") == F.col("text")) | F.octet_length("head").between(97, 100))
    return rows.select("doc_id", F.least(F.length("text"), F.lit(100)).alias("most"), whole.alias("whole"))


@_query("""SELECT event_id, '{"my_key":"***","in":{"Password":"***","n":' || event_id || '},"list":[{"token":1}]}' AS said FROM events""")
def q_redacted_json(spark, sf_dir):
    number = F.col("event_id").cast("string")
    body = F.concat(F.lit('{"my_key": "x", "in": {"Password": {"a": 1}, "n": '), number, F.lit('}, "list": [{"token": 1}]}'))
    return _table(spark, sf_dir, "events").select("event_id", X.redacted_json(body).alias("said"))


@_query("SELECT conv_id AS stream_id, string_agg(replace(text, 'e', 'é€'), '' ORDER BY turn) AS text, true AS same FROM conversations GROUP BY conv_id")
def q_restore_bytes(spark, sf_dir):
    """Streams of bytes cut every five, inside of characters and tokens; and the same streams in a small buffer."""
    masked = F.replace("text", F.lit("e"), F.lit("<INTERNAL_1A>"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", masked.alias("text")).alias("t"))
    bodies = turns.groupBy(F.col("conv_id").alias("stream_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["text"]), "").alias("body"))
    # what is made of a whole body is made below the explode, or each of its chunks would make it again
    whole = bodies.select("stream_id", "body", F.encode("body", "UTF-8").alias("b"), F.length("body").alias("n"))
    cut = whole.select("stream_id", F.posexplode(F.sequence(F.lit(1), F.greatest(F.length("b"), F.lit(1)), F.lit(5))).alias("seq", "at"), "b")
    chunks = cut.select("stream_id", F.col("seq").cast("long").alias("seq"), F.substring("b", F.col("at"), F.lit(5)).alias("chunk"), (F.col("at") + 5 > F.length("b")).alias("is_last"))
    # a chunk whose text waits for a later one gives an empty text; the first one keeps its stream
    joined = lambda rows, name: rows.filter("text <> '' OR seq = 0").groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias(name))
    mapping = {"<INTERNAL_1A>": "é€"}
    pieces = whole.select("stream_id", F.posexplode(F.when(F.col("n") == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all("body", F.lit(r"(?s).{1,7}"), F.lit(0)))).alias("seq", "chunk"), "n")
    pieces = pieces.select("stream_id", F.col("seq").cast("long").alias("seq"), "chunk", ((F.col("seq") + 1) * 7 >= F.col("n")).alias("is_last"))
    both = joined(restoring.restore_byte_streams(chunks, mapping), "text").join(joined(restoring.restore_buffered(pieces, mapping, 40), "buffered"), "stream_id")
    return both.select("stream_id", "text", (F.col("text") == F.col("buffered")).alias("same"))


@_query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)MIT License', '<LICENSE_1A>', 'g'), '(?i)Apache License', '<LICENSE_1B>', 'g') AS masked, CAST(len(regexp_extract_all(text, '(?i)(MIT|Apache) License')) AS BIGINT) AS spans FROM documents")
def q_sql_functions(spark, sf_dir):
    sql.register(spark, LICENSES, "maskloom_")
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return rows.selectExpr("doc_id", "maskloom_mask_text(text) AS masked", "cast(size(maskloom_mask_spans(text)) AS bigint) AS spans")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
