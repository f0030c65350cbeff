"""Queries that apply single-string functions, policies and dictionary checks to whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import text as X
from maskloom.operators import dialect, gateway, guard, jsonwalk, masking
from maskloom.sources import dictionary as D
from maskloom.sources import sse
from maskloom.streaming import restoring

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LICENSE = D.parse_dictionary("LICENSE: [MIT License]")
THE = D.parse_dictionary("WORD: [the]")


@_query("SELECT doc_id, text AS clean FROM documents")
def q_sanitize_documents(spark, sf_dir):
    """Invisible characters put in front of every comma go, all others stay."""
    spoiled = F.regexp_replace("text", ",", "​­,‮")
    return _table(spark, sf_dir, "documents").select("doc_id", X.sanitized(spoiled).alias("clean"))


@_query("SELECT doc_id, replace(replace(text, ', ', ' <<P_9>> '), '. ', ' <<Q_1A>> ') AS escaped FROM documents")
def q_escape_documents(spark, sf_dir):
    """Look-alikes in single brackets get double ones; those that have them stay."""
    alike = F.replace(F.replace("text", F.lit(", "), F.lit(" <P_9> ")), F.lit(". "), F.lit(" <<Q_1A>> "))
    return _table(spark, sf_dir, "documents").select("doc_id", X.escape_look_alikes(alike).alias("escaped"))


@_query(
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)MIT License')) AS BIGINT) AS bypassed, text AS masked,
  CAST(len(regexp_extract_all(text, '(?i)MIT License')) > 0 AS BOOLEAN) AS told FROM documents"""
)
def q_bypass_documents(spark, sf_dir):
    """Terms behind a backslash are kept and counted, and are no leak; with them in, the check trips (told)."""
    marked = F.regexp_replace("text", "(?i)(MIT License)", r"\\$1")
    rows = masking.mask(_table(spark, sf_dir, "documents").select("doc_id", marked.alias("text")), "text", LICENSE, escape=True)
    rows = rows.withColumn("told", guard.leak(F.col("masked"), LICENSE))
    rows = guard.guarded(rows, "masked", LICENSE, bypassed="bypassed_surfaces")
    return rows.select("doc_id", F.coalesce(F.element_at("bypassed", "LICENSE"), F.lit(0)).cast("long").alias("bypassed"), "masked", "told")


@_query(
    r"""WITH c AS (SELECT c_custkey AS k, '<X_' || (c_custkey % 7) || 'A>' AS x, '<Y_' || (c_custkey % 5) || 'B>' AS y, '<X_' || (c_custkey % 3) || 'A>' AS known FROM customer)
  SELECT k, x AS token FROM c WHERE x <> known UNION ALL SELECT k, y FROM c"""
)
def q_unmapped_tokens_of_customers(spark, sf_dir):
    k = F.col("c_custkey")
    token = lambda name, n, letter: F.concat(F.lit(f"<{name}_"), (k % n).cast("string"), F.lit(f"{letter}>"))
    rows = _table(spark, sf_dir, "customer").select(k.alias("k"), F.concat(token("X", 7, "A"), F.lit(" and "), token("Y", 5, "B")).alias("text"), token("X", 3, "A").alias("known"))
    found = rows.select("k", F.explode(F.regexp_extract_all("text", F.lit(X.TOKEN), F.lit(0))).alias("token"))
    return found.join(rows.select("k", F.col("known").alias("token")), ["k", "token"], "left_anti")


@_query("SELECT 'd' || n_regionkey AS name, 'R' || n_regionkey AS category, CAST(count(*) AS BIGINT) AS commented FROM nation WHERE n_nationkey % 2 = 0 GROUP BY n_regionkey")
def q_commented_nations(spark, sf_dir):
    """A dictionary of each region, in which the nations of even number are commented out."""
    line = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "  # - ").otherwise("  - "), "n_name")
    files = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    region = F.col("n_regionkey").cast("string")
    return D.commented_terms(files.select(F.concat(F.lit("d"), region).alias("name"), F.concat(F.lit("R"), region, F.lit(":\n"), "lines", F.lit("\n  # note")).alias("content")))


@_query(
    """WITH e AS (SELECT 'R' || (c_custkey % 3) AS category, c_custkey AS ord, CASE c_custkey % 5 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'x' WHEN 2 THEN ' , ' WHEN 3 THEN c_name ELSE c_name || chr(7) END AS entry FROM customer),
  s AS (SELECT entry FROM e GROUP BY entry HAVING count(DISTINCT category) > 1)
  SELECT category, ord, CASE ord % 5 WHEN 1 THEN 'one character' WHEN 2 THEN 'empty' WHEN 4 THEN 'control character' ELSE CASE WHEN entry IN (SELECT entry FROM s) THEN 'two categories' ELSE 'ok' END END AS problem FROM e"""
)
def q_lint_customers(spark, sf_dir):
    k = F.col("c_custkey")
    entry = F.when(k % 5 == 0, F.col("c_mktsegment")).when(k % 5 == 1, "x").when(k % 5 == 2, " , ").when(k % 5 == 3, F.col("c_name")).otherwise(F.concat("c_name", F.lit("\x07")))
    entries = _table(spark, sf_dir, "customer").select(F.concat(F.lit("R"), (k % 3).cast("string")).alias("category"), k.alias("ord"), entry.alias("entry"), F.lit(False).alias("allow_short"))
    return D.lint(entries).select("category", "ord", "problem")


@_query(
    """WITH e AS (SELECT CASE event_id % 6 WHEN 0 THEN 'length' WHEN 1 THEN 'tool_calls' WHEN 2 THEN 'function_call' WHEN 3 THEN 'content_filter' WHEN 4 THEN 'stop' END AS finish FROM events),
  s AS (SELECT finish, CASE WHEN finish = 'length' THEN 'max_tokens' WHEN finish IN ('tool_calls', 'function_call') THEN 'tool_use' WHEN finish = 'content_filter' THEN 'refusal' ELSE 'end_turn' END AS stop FROM e)
  SELECT finish, stop, CASE stop WHEN 'max_tokens' THEN 'length' WHEN 'tool_use' THEN 'tool_calls' WHEN 'refusal' THEN 'content_filter' ELSE 'stop' END AS back, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY finish, stop"""
)
def q_stop_reasons_of_events(spark, sf_dir):
    reasons = F.array(*map(F.lit, ("length", "tool_calls", "function_call", "content_filter", "stop", None)))
    rows = _table(spark, sf_dir, "events").select(F.get(reasons, (F.col("event_id") % 6).cast("int")).alias("finish"))
    rows = rows.withColumn("stop", dialect.stop_reason(F.col("finish"))).withColumn("back", dialect.finish_reason(F.col("stop")))
    return rows.groupBy("finish", "stop", "back").agg(F.count("*").alias("n"))


@_query(
    """SELECT event_id, CAST(CASE WHEN event_id % 11 = 0 THEN 400 WHEN event_id % 3 = 0 THEN 405 WHEN event_id % 7 = 0 THEN 400 WHEN event_id % 5 = 0 THEN 415
  WHEN event_id * 1000 > 8388608 THEN 413 ELSE 200 END AS BIGINT) AS status FROM events"""
)
def q_admission_of_events(spark, sf_dir):
    k = F.col("event_id")
    every = lambda n, yes, no: F.when(k % n == 0, yes).otherwise(no)
    headers = F.create_map(F.lit("Content-Type"), every(5, F.lit("text/plain"), F.lit("application/json; charset=utf-8")), F.lit("Content-Length"), (k * 1000).cast("string"))
    status = gateway.admission_status(every(3, F.lit("GET"), F.lit("POST")), every(7, F.lit("/v1/../x"), F.lit("/v1/messages")), every(11, F.lit(51), F.lit(2)), headers)
    return _table(spark, sf_dir, "events").select("event_id", status.cast("long").alias("status"))


@_query(
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber % 4 = 0 THEN 400 WHEN l_quantity - 3 <= 0 THEN 400 WHEN l_partkey % 3 > 2.0 - l_linenumber % 2 * 0.5 THEN 400 ELSE 200 END AS BIGINT) AS status FROM lineitem"""
)
def q_body_of_lineitems(spark, sf_dir):
    number = lambda c: c.cast("string")
    heat = (F.col("l_partkey") % 3).cast("double") + (F.col("l_linenumber") % 2).cast("double") * 0.5
    body = F.concat(F.lit('{"model":"m","max_tokens":'), number(F.col("l_quantity").cast("long") - 3), F.lit(',"temperature":'), number(heat), F.when(F.col("l_linenumber") % 4 == 0, "").otherwise("}"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", gateway.body_status(body).cast("long").alias("status"))


@_query(
    """SELECT page_id, CASE WHEN page_id % 5 = 1 THEN 'scheme' WHEN page_id % 5 = 2 THEN 'user info' WHEN page_id % 5 = 3 THEN 'host' WHEN page_id % 5 = 4 AND page_id % 2 = 0 THEN 'port' ELSE 'ok' END AS problem FROM pages"""
)
def q_endpoints_of_pages(spark, sf_dir):
    k, host = F.col("page_id"), F.regexp_extract("url", "https?://([^/]*)", 1)
    url = F.when(k % 5 == 1, F.regexp_replace("url", "^https?", "ftp")).when(k % 5 == 2, F.concat(F.lit("https://user@"), host)).when(k % 5 == 3, F.concat(F.lit("http://169.254."), (k % 256).cast("string"), F.lit(".1/")))
    url = url.when(k % 5 == 4, F.concat(F.lit("http://"), host, F.when(k % 2 == 0, ":6379/x").otherwise(":8443/x"))).otherwise(F.col("url"))
    return _table(spark, sf_dir, "pages").select("page_id", gateway.endpoint_problem(url).alias("problem"))


@_query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS pos, role AS event, text AS data FROM conversations")
def q_events_of_conversations(spark, sf_dir):
    """Each conversation as the body of an event stream, an event for each turn, written and parsed again."""
    one = X.sse_event(F.col("role"), F.col("text"), F.col("turn").cast("string"), F.lit(None).cast("double"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", one.alias("event")).alias("e"))
    bodies = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["event"]), "").alias("body"))
    return sse.parse_events(bodies, "body").select("conv_id", F.col("pos").cast("long").alias("pos"), "event", "data")


@_query("SELECT conv_id AS stream_id, string_agg(replace(text, 'e', '알파테크'), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def q_restore_conversations(spark, sf_dir):
    """Each conversation as a stream of text, cut every nine characters, most tokens in two."""
    masked = F.replace("text", F.lit("e"), F.lit("<INTERNAL_1A>"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", masked.alias("text")).alias("t"))
    bodies = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["text"]), "").alias("body"))
    cut = bodies.select(F.col("conv_id").alias("stream_id"), F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s).{1,9}"), F.lit(0))).alias("seq", "chunk"), F.length("body").alias("n"))
    chunks = cut.select("stream_id", F.col("seq").cast("long").alias("seq"), "chunk", ((F.col("seq") + 1) * 9 >= F.col("n")).alias("is_last"))
    rows = restoring.restore_streams(chunks, {"<INTERNAL_1A>": "알파테크"})
    return rows.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"))


@_query("""SELECT doc_id, CAST(len(string_split(text, ', ')) - 1 AS BIGINT) AS tokens, CAST(len(list_filter(string_split(text, ', '), lambda x: x <> '')) AS BIGINT) AS texts, CAST(length(replace(text, ', ', '<X_1A>')) AS BIGINT) AS chars FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def q_segments_of_documents(spark, sf_dir):
    """Texts with a known token in place of each comma, cut into segments."""
    rows = _table(spark, sf_dir, "documents")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(", "), F.lit("<X_1A>"))
    rows = rows.select("doc_id", masking.segments(text, F.array(F.lit("<X_1A>"))).alias("s"))
    tokens = F.size(F.filter("s", lambda x: x["is_token"])).cast("long")
    chars = F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.length(x["text"]))
    return rows.select("doc_id", tokens.alias("tokens"), (F.size("s") - tokens).alias("texts"), chars.alias("chars"))


@_query("SELECT c_custkey, n AS name, CASE WHEN n LIKE '%KEY%' OR n LIKE '%Token%' THEN '***' ELSE c_name END AS value FROM (SELECT c_custkey, c_name, unnest(['API_KEY_' || c_nationkey, 'myToken', 'segment']) AS n FROM customer)")
def q_redact_customers(spark, sf_dir):
    names = F.array(F.concat(F.lit("API_KEY_"), F.col("c_nationkey").cast("string")), F.lit("myToken"), F.lit("segment"))
    settings = F.map_from_arrays(names, F.array_repeat("c_name", 3))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.explode(X.redacted_map(settings)).alias("name", "value"))


@_query("SELECT page_id, 'at [REDACTED_PATH] of ' || url AS said FROM pages")
def q_scrub_pages(spark, sf_dir):
    said = F.concat(F.lit("at /opt/app/"), F.col("page_id").cast("string"), F.lit("/x.ts:3 of "), F.col("url"))
    return _table(spark, sf_dir, "pages").select("page_id", X.scrub_server_paths(said).alias("said"))


@_query(
    r"""SELECT conv_id, string_agg(regexp_replace(text, '(?i)\bthe\b', '<WORD_1A>', 'g'), chr(10) ORDER BY turn) AS said FROM conversations WHERE role <> 'system' GROUP BY conv_id"""
)
def q_mask_conversations(spark, sf_dir):
    """Requests of whole conversations: a term has one token in all messages of a request."""
    rows = dialect.to_messages(_table(spark, sf_dir, "conversations")).filter(F.size("messages") > 0)
    requests = dialect.request_json(rows, F.lit("m")).select("conv_id", "body", F.lit("anthropic").alias("dialect"))
    said = F.from_json("masked_body", "messages array<struct<content:string>>")["messages"]
    return jsonwalk.mask_requests(requests, THE).select("conv_id", F.array_join(F.transform(said, lambda m: m["content"]), "\n").alias("said"))


@_query(
    """SELECT c_custkey, 'C' || c_nationkey || ' · ' || length(c_name) || ' chars' AS label, 'https://a.example/v1/' || CASE WHEN c_custkey % 3 = 0 THEN 'messages' WHEN c_custkey % 3 = 1 THEN 'responses' ELSE 'chat/completions' END AS url,
  CASE WHEN c_custkey % 2 = 0 THEN '10.0.0.' || (c_custkey % 256) ELSE '127.0.0.1' END AS ip, 'X ' || c_name AS header, c_name || '.pdf' AS file FROM customer"""
)
def q_small_formats_of_customers(spark, sf_dir):
    k, name = F.col("c_custkey"), F.col("c_name")
    kind = F.when(k % 3 == 0, "anthropic").when(k % 3 == 1, "responses").otherwise("openai")
    forwarded = F.when(k % 2 == 0, F.concat(F.lit("10.0.0."), (k % 256).cast("string"), F.lit(", 1.1.1.1"))).otherwise("unknown")
    return _table(spark, sf_dir, "customer").select(
        "c_custkey",
        X.masked_label(F.concat(F.lit("C"), F.col("c_nationkey").cast("string")), name).alias("label"),
        X.endpoint_url(F.lit("https://a.example//"), kind, F.lit(None).cast("string")).alias("url"),
        X.client_ip(forwarded, F.lit(None).cast("string")).alias("ip"),
        X.clean_header(F.concat(F.lit(" X\r\n"), name, F.lit("\x01 "))).alias("header"),
        X.clean_file_name(F.concat(F.lit("../"), name, F.lit("\x00.pdf"))).alias("file"),
    )


@_query("SELECT event_id, strftime(ts, '%Y%m%d-%H%M') AS slug, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM events")
def q_times_of_events(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return _table(spark, sf_dir, "events").select("event_id", X.time_slug(ts).alias("slug"), X.iso_time(F.unix_millis(ts)).alias("iso"))


@_query(
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'a_to_o' WHEN 1 THEN 'o_to_a' ELSE 'same' END AS way, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'chairs' ELSE c_mktsegment END AS model FROM customer"""
)
def q_directions_of_customers(spark, sf_dir):
    k = F.col("c_custkey") % 3
    source, target = F.when(k == 0, "anthropic").otherwise("openai"), F.when(k == 1, "anthropic").otherwise("openai")
    models = F.create_map(F.lit("FURNITURE"), F.lit("chairs"))
    return _table(spark, sf_dir, "customer").select("c_custkey", dialect.direction(source, target).alias("way"), dialect.mapped_model(F.col("c_mktsegment"), models).alias("model"))


@_query(r"""SELECT doc_id, regexp_replace(text, '(?i)MIT License', '[LICENSE/1A]', 'g') AS masked, text AS lower_restored FROM (SELECT doc_id, replace(text, 'mit license', 'MIT License') AS text FROM documents)""")
def q_own_token_format(spark, sf_dir):
    """Masking and restoring with tokens of another form."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("mit license"), F.lit("MIT License")).alias("text"))
    rows = masking.mask(rows, "text", LICENSE, token_format="[{type}/{n}]")
    return masking.restore(rows, "masked", "entries", token_format="[{type}/{n}]").select("doc_id", "masked", F.col("restored_text").alias("lower_restored"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
