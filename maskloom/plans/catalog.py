"""The queries of the de-identification library, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import text as X
from maskloom.operators import dialect, gateway, guard, jsonwalk, masking, observe, translate
from maskloom.plans import fixtures, report_queries, session_queries, table_queries
from maskloom.sources import dictionary as D
from maskloom.streaming import restoring, translating

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(rows: list[tuple], *names: str) -> str:
    """Rows as SQL."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS BIGINT)" if isinstance(v, int) else str(v)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({', '.join(names)})"


DOCUMENTS = D.parse_dictionary(fixtures.DOCUMENTS_YAML)
PARITY = D.parse_dictionary(fixtures.PARITY_YAML)
NUMBERS = D.parse_dictionary("IP:\n  patterns:\n    - '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}'")
PHRASES = D.parse_dictionary("LICENSE: [MIT License]\nCORP: [the]")
_IP = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
_IP_PIECES = f"""
  h AS (SELECT doc_id, lang, text, regexp_extract_all(text, '{_IP}') AS hits, string_split_regex(text, '{_IP}') AS pieces FROM documents),
  x AS (SELECT doc_id, lang, unnest(range(1, len(hits) + 1)) AS i, hits, pieces FROM h WHERE len(hits) > 0),
  s AS (SELECT doc_id, lang, i, hits[i] AS surface,
               list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda p: length(p))), 0) AS start FROM x),
  f AS (SELECT *, min(i) OVER (PARTITION BY doc_id, surface) AS first_i FROM s),
  t AS (SELECT *, '<IP_' || dense_rank() OVER (PARTITION BY doc_id ORDER BY first_i) || 'A>' AS token FROM f)
"""


@_query(
    rf"""SELECT lang, entity, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents FROM (
  SELECT doc_id, lang, 'IP' AS entity, unnest(regexp_extract_all(text, '{_IP}')) AS x FROM documents
  UNION ALL SELECT doc_id, lang, 'SECRET', unnest(regexp_extract_all(text, '[0-9a-f]{{40}}')) FROM documents
  UNION ALL SELECT doc_id, lang, 'EMAIL', unnest(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]')) FROM documents
) GROUP BY lang, entity"""
)
def q_pattern_hits_by_lang(spark, sf_dir):
    patterns = D.Dictionary(patterns=DOCUMENTS.patterns)
    rows = masking.find_spans(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "text", patterns)
    hits = masking.spans_relation(rows, "doc_id", "lang")
    return hits.groupBy("lang", "entity").agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("documents"))


@_query(
    r"""SELECT term, CAST(sum(n) AS BIGINT) AS hits FROM (
  SELECT 'the' AS term, len(regexp_extract_all(regexp_replace(lower(text), '([^a-z0-9])', '\1\1', 'g'), '(?:^|[^a-z0-9])the(?:$|[^a-z0-9])')) AS n FROM documents
  UNION ALL SELECT 'that', len(regexp_extract_all(regexp_replace(lower(text), '([^a-z0-9])', '\1\1', 'g'), '(?:^|[^a-z0-9])that(?:$|[^a-z0-9])')) FROM documents
  UNION ALL SELECT 'for', len(regexp_extract_all(regexp_replace(lower(text), '([^a-z0-9])', '\1\1', 'g'), '(?:^|[^a-z0-9])for(?:$|[^a-z0-9])')) FROM documents
) GROUP BY term"""
)
def q_term_hits(spark, sf_dir):
    terms = D.Dictionary(terms=[t for t in DOCUMENTS.terms if t.entity == "PHRASE"])
    rows = masking.find_spans(_table(spark, sf_dir, "documents").select("text"), "text", terms)
    hits = masking.spans_relation(rows).groupBy("surface").agg(F.count("*").alias("n"))
    return hits.groupBy(masking.term_key(F.col("surface")).alias("term")).agg(F.sum("n").alias("hits"))


@_query(f'WITH {_IP_PIECES} SELECT doc_id, CAST(start AS INT) AS "start", CAST(start + length(surface) AS INT) AS "end", \'IP\' AS entity, surface FROM s')
def q_spans_positions(spark, sf_dir):
    rows = masking.find_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", NUMBERS)
    return masking.spans_relation(rows, "doc_id").select("doc_id", "start", "end", "entity", "surface")


@_query(
    f"""WITH {_IP_PIECES},
  m AS (SELECT t.doc_id, string_agg(t.token || h.pieces[t.i + 1], '' ORDER BY t.i) AS rest FROM t JOIN h ON h.doc_id = t.doc_id GROUP BY t.doc_id)
  SELECT h.doc_id, CASE WHEN m.rest IS NULL THEN h.text ELSE h.pieces[1] || m.rest END AS masked FROM h LEFT JOIN m ON m.doc_id = h.doc_id"""
)
def q_mask_documents_patterns(spark, sf_dir):
    return masking.mask(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", NUMBERS).select("doc_id", "masked")


@_query("SELECT doc_id, regexp_replace(text, '(?i)MIT License', '<LICENSE_1A>', 'g') AS masked FROM documents")
def q_mask_documents_terms(spark, sf_dir):
    terms = D.parse_dictionary("LICENSE: [MIT License]")
    return masking.mask(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", terms).select("doc_id", "masked")


@_query(f"WITH {_IP_PIECES} SELECT DISTINCT doc_id, token, 'IP' AS entity, surface AS term FROM t")
def q_mapping_relation(spark, sf_dir):
    return masking.mapping_relation(masking.mask(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", NUMBERS), "doc_id")


@_query(f"WITH {_IP_PIECES} SELECT lang, 'IP' AS entity, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents, CAST(count(*) AS BIGINT) AS hits, max(g) AS max_group FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY first_i) AS INT) AS g FROM f) GROUP BY lang")
def q_activity_by_lang(spark, sf_dir):
    return observe.activity(masking.mask(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "text", NUMBERS), "lang")


@_query("SELECT doc_id, text AS restored_text, true AS same FROM documents")
def q_restore_roundtrip(spark, sf_dir):
    rows = masking.restore(masking.mask(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", D.Dictionary(patterns=DOCUMENTS.patterns)), "masked", "entries")
    return rows.select("doc_id", "restored_text", (F.col("restored_text") == F.col("text")).alias("same"))


_TOKENS = [("a <X_1A> b <Y_2B>", "<X_1A>"), ("<Z_1A><X_1A>", "<Z_1A>"), ("none", "<X_1A>")]


@_query(_values([("a <X_1A> b <Y_2B>", "<Y_2B>"), ("<Z_1A><X_1A>", "<X_1A>")], "text", "token"))
def q_unmapped_tokens(spark, sf_dir):
    rows = spark.createDataFrame(_TOKENS, "text string, known string")
    found = rows.select("text", F.explode(F.regexp_extract_all("text", F.lit(X.TOKEN), F.lit(0))).alias("token"))
    return found.join(rows.select("text", F.col("known").alias("token")), ["text", "token"], "left_anti")


@_query(
    rf"""SELECT doc_id, CAST(regexp_matches(text, '{_IP}') AS BIGINT) AS ip, CAST(regexp_matches(text, '[0-9a-f]{{40}}') AS BIGINT) AS secret FROM documents
  WHERE regexp_matches(text, '{_IP}') OR regexp_matches(text, '[0-9a-f]{{40}}')"""
)
def q_guard_scan_raw(spark, sf_dir):
    rules = D.Dictionary(patterns=[p for p in DOCUMENTS.patterns if p[1] in ("IP", "SECRET")])
    rows = _table(spark, sf_dir, "documents").select("doc_id", guard.leaks(F.col("text"), rules).alias("leaks")).filter(F.size("leaks") > 0)
    return rows.select("doc_id", *(F.coalesce(F.element_at("leaks", k.upper()), F.lit(0)).cast("long").alias(k) for k in ("ip", "secret")))


@_query(
    """SELECT lang, CAST(count(*) AS BIGINT) AS documents, CAST(count(*) FILTER (bad) AS BIGINT) AS leaks, CAST(count(*) FILTER (bad) AS BIGINT) AS withheld
  FROM (SELECT lang, regexp_matches(text, '(?i)(^|[^A-Za-z0-9])Apache License($|[^A-Za-z0-9])') AS bad FROM documents) GROUP BY lang"""
)
def q_guard_scan_masked(spark, sf_dir):
    """Texts masked by one dictionary, checked by one that knows a term more."""
    checked = D.Dictionary(terms=DOCUMENTS.terms + D.parse_dictionary("LICENSE: [Apache License]").terms, patterns=DOCUMENTS.patterns)
    rows = guard.guarded(masking.mask(_table(spark, sf_dir, "documents").select("lang", "text"), "text", DOCUMENTS), "masked", checked)
    return rows.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if("leak").alias("leaks"), F.count_if(F.col("masked").isNull()).alias("withheld"))


_UNCLEAN = [(1, "a​b﻿c", "abc"), (2, "‮x⁦y­", "xy"), (3, "plain", "plain"), (4, "\u0000⁠", "")]


@_query(_values([(k, t) for k, _, t in _UNCLEAN], "id", "clean"))
def q_sanitize(spark, sf_dir):
    return spark.createDataFrame([(k, t) for k, t, _ in _UNCLEAN], "id long, t string").select("id", X.sanitized(F.col("t")).alias("clean"))


_LOOKS = [(1, "<P_9> <<X_1A>> <<X_1A> <X_1A>>", "<<P_9>> <<X_1A>> <<<X_1A>> <<X_1A>>>"), (2, "a < b", "a < b"), (3, "<P_9A>", "<<P_9A>>"), (4, "<p_9>", "<p_9>")]


@_query(_values([(k, t) for k, _, t in _LOOKS], "id", "escaped"))
def q_escape_lookalikes(spark, sf_dir):
    return spark.createDataFrame([(k, t) for k, t, _ in _LOOKS], "id long, t string").select("id", X.escape_look_alikes(F.col("t")).alias("escaped"))


@_query(_values([(1, "CORP and <CUSTOMER_1A>", 1), (2, "<CUSTOMER_1A>", 0)], "id", "masked", "bypassed"))
def q_escape_bypass(spark, sf_dir):
    df = spark.createDataFrame([(1, "\\CORP and CORP"), (2, "CORP")], "id long, text string")
    rows = masking.mask(df, "text", PARITY, escape=True)
    return rows.select("id", "masked", F.coalesce(F.element_at("bypassed", "CUSTOMER"), F.lit(0)).cast("long").alias("bypassed"))


@_query(_values([(n, m, t if r is None else r, False) for n, t, m, r in fixtures.PARITY_VECTORS], "name", "masked", "restored_text", "leak"))
def q_parity_vectors(spark, sf_dir):
    df = spark.createDataFrame([(v[0], v[1]) for v in fixtures.PARITY_VECTORS], "name string, text string")
    rows = guard.guarded(masking.restore(masking.mask(df, "text", PARITY), "masked", "entries"), "masked", PARITY)
    return rows.select("name", "masked", "restored_text", "leak")


_COMMENTED = "INTERNAL:\n  - a\n  # - b\nPROJECT:\n  # - c, d\n  #- e\n  # note\nX: [y]\n"


@_query(_values([("d.yaml", "INTERNAL", 1), ("d.yaml", "PROJECT", 2)], "name", "category", "commented"))
def q_commented_terms(spark, sf_dir):
    return D.commented_terms(spark.createDataFrame([("d.yaml", _COMMENTED)], "name string, content string"))


@_query(
    """WITH e AS (SELECT r_name, n_nationkey, n_name, min(n_nationkey) OVER (PARTITION BY r_name, n_name) AS first_key FROM nation JOIN region ON n_regionkey = r_regionkey),
  s AS (SELECT *, dense_rank() OVER (PARTITION BY r_name ORDER BY first_key) AS g FROM e)
  SELECT r_name AS category, n_nationkey AS ord, CAST(g AS INT) AS group_no, n_name AS alias, g || 'A' AS token_suffix FROM s"""
)
def q_alias_groups(spark, sf_dir):
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    entries = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("category"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("entry"))
    return D.alias_groups(entries).select("category", "ord", "group_no", "alias", "token_suffix")


_ENTRIES = [("A", 0, "x y", False, "ok"), ("a", 1, "t", False, "category name"), ("A", 2, " , ", False, "empty"), ("A", 3, "q", False, "one character"), ("A", 4, "q", True, "ok"), ("A", 5, "same", False, "two categories"), ("B", 6, "same", False, "two categories"), ("B", 7, "a\x07b", False, "control character"), ("B", 8, "\U0001f600", False, "ok")]


@_query(_values([(c, o, p) for c, o, _, _, p in _ENTRIES], "category", "ord", "problem"))
def q_dictionary_lint(spark, sf_dir):
    return D.lint(spark.createDataFrame([e[:4] for e in _ENTRIES], "category string, ord long, entry string, allow_short boolean")).select("category", "ord", "problem")


@_query(_values([("CUSTOMER", 1, 0, 0), ("EMAIL", 0, 0, 1), ("INTERNAL", 2, 1, 0), ("PHONE", 0, 0, 1), ("PROJECT", 2, 0, 0)], "category", "terms", "strict", "patterns"))
def q_dictionary_summary(spark, sf_dir):
    return D.summary(spark, PARITY)


_REASONS = [("length", "max_tokens"), ("tool_calls", "tool_use"), ("function_call", "tool_use"), ("content_filter", "refusal"), ("stop", "end_turn"), (None, "end_turn")]


@_query(_values([(f, s, {"max_tokens": "length", "tool_use": "tool_calls", "refusal": "content_filter"}.get(s, "stop")) for f, s in _REASONS], "finish", "stop", "back"))
def q_stop_reason_matrix(spark, sf_dir):
    rows = spark.createDataFrame([(f,) for f, _ in _REASONS], "finish string").withColumn("stop", dialect.stop_reason(F.col("finish")))
    return rows.withColumn("back", dialect.finish_reason(F.col("stop")))


_JSON = {"content-type": "application/json"}
_REQUESTS = [
    (1, "POST", "/v1/messages", 0, _JSON, 200),
    (2, "GET", "/v1/messages", 0, _JSON, 405),
    (3, "POST", "/" + "a" * 2048, 0, _JSON, 414),
    (4, "POST", "/v1/../x", 0, _JSON, 400),
    (5, "POST", "/v1/messages", 51, _JSON, 400),
    (6, "POST", "/v1/messages", 0, {"content-type": "text/plain"}, 415),
    (7, "POST", "/v1/messages", 0, {"Content-Type": "application/json; charset=utf-16"}, 415),
    (8, "POST", "/v1/messages", 0, {"content-type": "application/json; charset=utf-8; x=1"}, 400),
    (9, "POST", "/v1/messages", 0, _JSON | {"content-length": "9000000"}, 413),
    (10, "POST", "/v1/messages", 0, _JSON | {"content-length": "x"}, 400),
    (11, "POST", "/v1/messages", 0, _JSON | {"transfer-encoding": "chunked", "content-length": "3"}, 400),
    (12, "POST", "/v1/messages", 0, {}, 415),
]


@_query(_values([(r[0], r[5]) for r in _REQUESTS], "id", "status"))
def q_admission_status(spark, sf_dir):
    rows = spark.createDataFrame([r[:5] for r in _REQUESTS], "id long, method string, path string, keys int, headers map<string,string>")
    return rows.select("id", gateway.admission_status(F.col("method"), F.col("path"), F.col("keys"), F.col("headers")).cast("long").alias("status"))


_BODIES = [(1, '{"model":"m","max_tokens":5,"temperature":1.5}', 200), (2, '{"max_tokens":0}', 400), (3, '{"max_tokens":1.5}', 400), (4, '{"temperature":2.1}', 400), (5, "{", 400), (6, '{"model":"' + "m" * 129 + '"}', 400), (7, "{}", 200)]


@_query(_values([(k, s) for k, _, s in _BODIES], "id", "status"))
def q_body_status(spark, sf_dir):
    return spark.createDataFrame([(k, b) for k, b, _ in _BODIES], "id long, body string").select("id", gateway.body_status(F.col("body")).cast("long").alias("status"))


_URLS = [("https://api.example.com/v1", "ok"), ("ftp://a.example", "scheme"), ("https://u:p@a.example", "user info"), ("http://169.254.169.254/x", "host"), ("http://[fe80::1]/", "host"), ("http://a.example:6379", "port"), ("http://a.example:8443", "ok"), ("http://[::1]:80/", "host")]


@_query(_values(_URLS, "url", "problem"))
def q_ssrf_filter(spark, sf_dir):
    return spark.createDataFrame([(u,) for u, _ in _URLS], "url string").select("url", gateway.endpoint_problem(F.col("url")).alias("problem"))


@_query(_values([("api_key", "anthropic-version=1,authorization=Bearer k"), ("passthrough", "anthropic-version=1,authorization=Bearer c")], "auth", "sent"))
def q_header_filter(spark, sf_dir):
    given = {"Authorization": "Bearer c", "Anthropic-Version": "1", "Host": "x", "X-Other": "2", "Content-Length": "5"}
    rows = spark.createDataFrame([(a, given) for a in ("api_key", "passthrough")], "auth string, headers map<string,string>")
    sent = gateway.outbound_headers(F.col("headers"), F.col("auth"), F.lit("k"))
    return rows.select("auth", F.array_join(F.transform(F.array_sort(F.map_entries(sent)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("sent"))


@_query(_values([(1, "a", 200, 1), (2, "b", 200, 2), (3, "c", 500, 3), (4, "c", 402, 2), (5, "b", 502, 2)], "request_id", "provider", "status", "tried"))
def q_fallback_choice(spark, sf_dir):
    requests = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "b"), (5, "c")], "request_id long, provider string")
    providers = spark.createDataFrame([("a", True, None), ("b", False, 0), ("c", False, 1), ("d", False, None)], "name string, active boolean, fallback_pos int")
    upstream = spark.createDataFrame(
        [(1, "a", 200, {}, ""), (2, "a", 429, {}, ""), (2, "b", 200, {}, ""), (3, "a", 403, {}, "insufficient balance"), (3, "b", 500, {"Retry-After": "1"}, ""), (3, "c", 500, {}, ""), (4, "b", 402, {}, ""), (4, "c", 402, {}, ""), (5, "c", 529, {}, "")],
        "request_id long, provider string, status int, headers map<string,string>, body string",
    )
    chosen = gateway.fallback_choice(gateway.fallback_chain(requests, providers), upstream)
    return chosen.select("request_id", "provider", F.col("status").cast("long").alias("status"), F.col("tried").cast("long").alias("tried"))


@_query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def q_activity_last_n(spark, sf_dir):
    return observe.last_events(_table(spark, sf_dir, "events"), 50, "event_id").select("event_id", "user_id", "event_type")


_WINDOWS = [("2024-01-03 10:15:00", 90), ("2024-01-10 23:30:00", 1440), ("2024-01-20 00:00:00", 1), ("2024-01-21 00:00:00", 2000)]


@_query(
    f"""WITH w AS (SELECT CAST(f AS TIMESTAMP) AS f, m FROM (VALUES {", ".join(f"('{f}', {m})" for f, m in _WINDOWS)}) t(f, m) WHERE m BETWEEN 1 AND 1440)
  SELECT event_type, CAST(count(*) AS BIGINT) AS events, CAST(count(*) FILTER (EXISTS (SELECT 1 FROM w WHERE ts >= w.f AND ts < w.f + to_minutes(CAST(w.m AS INT)))) AS BIGINT) AS bypassed FROM events GROUP BY event_type"""
)
def q_bypass_window(spark, sf_dir):
    windows = spark.createDataFrame(_WINDOWS, "f string, minutes int").select(F.to_timestamp("f").cast(_table(spark, sf_dir, "events").schema["ts"].dataType).alias("from_ts"), "minutes")
    rows = observe.bypassed(_table(spark, sf_dir, "events"), windows)
    return rows.groupBy("event_type").agg(F.count("*").alias("events"), F.count_if("bypassed").alias("bypassed"))


@_query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  r AS (SELECT user_id, event_id, k, true AS admitted, [t] AS kept FROM e WHERE k = 1
    UNION ALL
    SELECT e.user_id, e.event_id, e.k, ok, CASE WHEN ok THEN list_append(kept, e.t)[-5:] ELSE kept END
    FROM (SELECT e.*, r.kept, len(r.kept) < 5 OR e.t - r.kept[1] >= 86400000 AS ok FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) e)
  SELECT user_id, event_id, admitted FROM r"""
)
def q_rate_limiter(spark, sf_dir):
    return observe.rate_limited(_table(spark, sf_dir, "events"), "user_id", "ts", window_ms=86_400_000, most=5)


_SSE = "event: a\ndata: {\"x\":1}\n\nid: 7\ndata: one\ndata: two\n\n: note\n\ndata: [DONE]\n\n"


@_query(_values([(0, "a", '{"x":1}'), (1, None, "one\ntwo"), (2, None, ""), (3, None, "[DONE]")], "pos", "event", "data"))
def q_sse_parse(spark, sf_dir):
    from maskloom.sources import sse

    return sse.parse_events(spark.createDataFrame([("s", _SSE)], "stream_id string, body string"), "body").select(F.col("pos").cast("long").alias("pos"), "event", "data")


@_query(_values([("event: a\nid: 1\nretry: 3\ndata: x\ndata: y\n\n",)], "text"))
def q_sse_format(spark, sf_dir):
    row = spark.createDataFrame([("a\r", "x\ny", "1", 3.7)], "e string, d string, i string, r double")
    return row.select(X.sse_event(F.col("e"), F.col("d"), F.col("i"), F.col("r")).alias("text"))


def _cut(stream: str, text: str, n: int) -> list[tuple]:
    parts = [text[k : k + n] for k in range(0, len(text), n)]
    return [(stream, k, p, k == len(parts) - 1) for k, p in enumerate(parts)]


_STREAM_MAP = {"<INTERNAL_1A>": "알파테크", "<PROJECT_1A>": "Project 오로라"}
_STREAM_TEXT = "답변: <INTERNAL_1A> 및 <PROJECT_1A>, <<X_9>> 그리고 <OTHER_1A> 1 < 2"


@_query(_values([(f"cut{n}", "답변: 알파테크 및 Project 오로라, <X_9> 그리고 <OTHER_1A> 1 < 2") for n in (1, 2, 3, 5, 100)], "stream_id", "text"))
def q_stream_restore(spark, sf_dir):
    chunks = spark.createDataFrame([r for n in (1, 2, 3, 5, 100) for r in _cut(f"cut{n}", _STREAM_TEXT, n)], "stream_id string, seq long, chunk string, is_last boolean")
    rows = restoring.restore_streams(chunks, _STREAM_MAP)
    return rows.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"))


@_query("SELECT conv_id AS stream_id, string_agg(replace(text, 'a', 'Project 오로라'), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def q_sse_restore(spark, sf_dir):
    """Each conversation as a stream of events, an event for each turn, cut every 50 characters."""
    masked = F.replace("text", F.lit("a"), F.lit("<PROJECT_1A>"))
    event = F.concat(F.lit("data: "), F.to_json(F.struct(masked.alias("text"))), F.lit("\n\n"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", event.alias("event"))
    body = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "event"))), lambda x: x["event"]), "").alias("body"))
    cut = body.select(F.col("conv_id").alias("stream_id"), F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s).{1,50}"), F.lit(0))).alias("seq", "chunk"), F.length("body").alias("n"))
    chunks = cut.select("stream_id", F.col("seq").cast("long").alias("seq"), "chunk", ((F.col("seq") + 1) * 50 >= F.col("n")).alias("is_last"))
    restored = restoring.restore_streams(chunks, _STREAM_MAP, sse=True)
    whole = restored.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("body"))
    said = F.transform(F.regexp_extract_all("body", F.lit(r"(?m)^data: (.*)$"), F.lit(1)), lambda e: F.get_json_object(e, "$.text"))
    return whole.select("stream_id", F.array_join(said, "").alias("text"))


@_query("SELECT conv_id AS stream_id, string_agg(text, '' ORDER BY turn) AS text, CAST(sum(turn) AS BIGINT) AS tokens FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def q_stream_translate(spark, sf_dir):
    """What assistants said as streams of completion chunks, cut every 60 characters, translated to message events."""
    said = _table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    chunk = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    body = said.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", chunk.alias("chunk")))), lambda x: F.concat(F.lit("data: "), x["chunk"], F.lit("\n\n"))), "").alias("body"),
        F.sum("turn").alias("tokens"),
    )
    usage = F.concat(F.lit('data: {"choices":[],"usage":{"completion_tokens":'), F.col("tokens").cast("string"), F.lit("}}\n\n"))
    body = body.select(F.col("conv_id").alias("stream_id"), F.concat("body", usage).alias("body"))
    cut = body.select("stream_id", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s).{1,60}"), F.lit(0))).alias("seq", "chunk"), F.length("body").alias("n"))
    chunks = cut.select("stream_id", F.col("seq").cast("long").alias("seq"), "chunk", ((F.col("seq") + 1) * 60 >= F.col("n")).alias("is_last"))
    out = translating.translate_streams(chunks, "openai", "anthropic")
    whole = out.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("body"))
    events = F.regexp_extract_all("body", F.lit(r"(?m)^data: (.*)$"), F.lit(1))
    texts = F.array_compact(F.transform(events, lambda e: F.get_json_object(e, "$.delta.text")))
    tokens = F.array_max(F.transform(events, lambda e: F.get_json_object(e, "$.usage.output_tokens").cast("long")))
    return whole.select("stream_id", F.array_join(texts, "").alias("text"), tokens.alias("tokens"))


_SEGMENTS = [(1, "a<X_1A>b<Y_1A>", [("a", False), ("<X_1A>", True), ("b", False), ("<Y_1A>", False)]), (2, "<X_1A>", [("<X_1A>", True)]), (3, "plain", [("plain", False)])]


@_query(_values([(k, n, t, b) for k, _, parts in _SEGMENTS for n, (t, b) in enumerate(parts)], "id", "pos", "text", "is_token"))
def q_segments(spark, sf_dir):
    rows = spark.createDataFrame([(k, t, ["<X_1A>"]) for k, t, _ in _SEGMENTS], "id long, text string, known array<string>")
    return rows.select("id", F.posexplode(masking.segments(F.col("text"), F.col("known"))).alias("pos", "s")).select("id", F.col("pos").cast("long").alias("pos"), "s.text", "s.is_token")


@_query("SELECT doc_id, regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9])MIT License(?:$|[^A-Za-z0-9])') AS blocked FROM documents")
def q_log_guard(spark, sf_dir):
    terms = D.parse_dictionary("LICENSE: [MIT License]")
    return _table(spark, sf_dir, "documents").select("doc_id", (observe.log_guard(F.col("text"), terms) == observe.BLOCKED).alias("blocked"))


@_query(_values([("API_KEY", "***"), ("host", "h"), ("my_password_2", "***")], "name", "value"))
def q_redact_secrets(spark, sf_dir):
    rows = spark.createDataFrame([({"API_KEY": "a", "host": "h", "my_password_2": "b"},)], "m map<string,string>")
    return rows.select(F.explode(X.redacted_map(F.col("m"))).alias("name", "value"))


@_query(_values([("at [REDACTED_PATH] line 1", "x/opt")], "a", "b"))
def q_scrub_paths(spark, sf_dir):
    rows = spark.createDataFrame([("at /opt/app/src/x.ts:3 line 1", "x/opt")], "a string, b string")
    return rows.select(*(X.scrub_server_paths(F.col(c)).alias(c) for c in "ab"))


@_query("SELECT page_id, regexp_matches(html, 'track\\(') AS tracks, regexp_matches(html, 'https?://') AS links FROM pages")
def q_url_scan_pages(spark, sf_dir):
    rows = observe.forbidden_strings(_table(spark, sf_dir, "pages"), "html", [("tracks", r"track\("), ("links", "https?://")])
    return rows.select("page_id", *(F.array_contains("found", n).alias(n) for n in ("tracks", "links")))


_TURNS = """WITH s AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id),
  m AS (SELECT conv_id, count(*) AS n, string_agg(role || ':' || text, chr(10) ORDER BY turn) AS said FROM conversations WHERE role <> 'system' GROUP BY conv_id)"""


@_query(_TURNS + " SELECT coalesce(s.conv_id, m.conv_id) AS conv_id, s.system, CAST(coalesce(m.n, 0) AS BIGINT) AS turns, coalesce(m.said, '') AS said FROM s FULL JOIN m ON s.conv_id = m.conv_id")
def q_conversation_messages(spark, sf_dir):
    rows = dialect.to_messages(_table(spark, sf_dir, "conversations"))
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return rows.select("conv_id", "system", F.size("messages").cast("long").alias("turns"), said.alias("said"))


@_query(_TURNS + " SELECT coalesce(s.conv_id, m.conv_id) AS conv_id, CAST(coalesce(m.n, 0) + CAST(s.system IS NOT NULL AS INT) AS BIGINT) AS turns, CASE WHEN s.system IS NULL THEN NULL ELSE 'system' END AS first_system FROM s FULL JOIN m ON s.conv_id = m.conv_id")
def q_conversation_completions(spark, sf_dir):
    rows = dialect.to_completions(_table(spark, sf_dir, "conversations"))
    first = F.get("messages", 0)["role"]
    return rows.select("conv_id", F.size("messages").cast("long").alias("turns"), F.when(first == "system", first).alias("first_system"))


def _requests(spark, sf_dir) -> DataFrame:
    """conv_id and body: each conversation as a request of the message format."""
    return dialect.request_json(dialect.to_messages(_table(spark, sf_dir, "conversations")), F.lit("small"), 100).select("conv_id", "body")


@_query(_TURNS + " SELECT coalesce(s.conv_id, m.conv_id) AS conv_id, 'large' AS model, coalesce('system:' || s.system || CASE WHEN m.n > 0 THEN chr(10) ELSE '' END, '') || coalesce(m.said, '') AS said FROM s FULL JOIN m ON s.conv_id = m.conv_id")
def q_translate_requests(spark, sf_dir):
    rows = translate.translated_requests(_requests(spark, sf_dir), F.lit("anthropic"), F.lit("openai"), {"small": "large"})
    body = F.from_json("translated_body", "model string, messages array<struct<role:string,content:string>>")
    rows = rows.select("conv_id", body.alias("b"))
    return rows.select("conv_id", "b.model", F.array_join(F.transform("b.messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n").alias("said"))


@_query(_TURNS + " SELECT coalesce(s.conv_id, m.conv_id) AS conv_id, s.system, CAST(100 AS BIGINT) AS max_tokens, CAST(coalesce(m.n, 0) AS BIGINT) AS turns FROM s FULL JOIN m ON s.conv_id = m.conv_id")
def q_translate_there_and_back(spark, sf_dir):
    there = translate.translated_requests(_requests(spark, sf_dir), F.lit("anthropic"), F.lit("openai")).select("conv_id", F.col("translated_body").alias("body"))
    back = translate.translated_requests(there, F.lit("openai"), F.lit("anthropic"))
    body = F.from_json("translated_body", "system string, max_tokens long, messages array<struct<role:string>>")
    return back.select("conv_id", body.alias("b")).select("conv_id", "b.system", "b.max_tokens", F.size("b.messages").cast("long").alias("turns"))


_ANSWERS = """WITH a AS (SELECT conv_id, turn, text, length(text) AS n FROM conversations WHERE role = 'assistant')"""


def _answers(spark, sf_dir) -> DataFrame:
    """conv_id, turn and body: each turn of an assistant as an answer of the message format."""
    said = _table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    usage = F.struct(F.col("turn").alias("input_tokens"), F.length("text").alias("output_tokens"))
    body = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content"), F.lit("max_tokens").alias("stop_reason"), usage.alias("usage")))
    return said.select("conv_id", "turn", body.alias("body"))


@_query(_ANSWERS + " SELECT conv_id, turn, text AS content, 'length' AS finish, CAST(turn + n AS BIGINT) AS total, 'asked' AS model FROM a")
def q_translate_answers(spark, sf_dir):
    rows = translate.translated_answers(_answers(spark, sf_dir), F.lit("anthropic"), F.lit("openai"), F.lit("asked"))
    body = F.from_json("translated_body", "model string, choices array<struct<message:struct<content:string>,finish_reason:string>>, usage struct<total_tokens:long>")
    rows = rows.select("conv_id", "turn", body.alias("b")).withColumn("c", F.get("b.choices", F.lit(0)))
    return rows.select("conv_id", "turn", F.col("c.message.content").alias("content"), F.col("c.finish_reason").alias("finish"), F.col("b.usage.total_tokens").alias("total"), "b.model")


@_query(_ANSWERS + " SELECT conv_id, CAST(count(*) AS BIGINT) AS answers, CAST(sum(turn) AS BIGINT) AS input_tokens, CAST(sum(n) AS BIGINT) AS output_tokens, CAST(sum(turn + n) AS BIGINT) AS total_tokens FROM a GROUP BY conv_id")
def q_usage_totals(spark, sf_dir):
    answers = translate.translated_answers(_answers(spark, sf_dir), F.lit("anthropic"), F.when(F.col("turn") % 2 == 0, "openai").otherwise("anthropic"))
    return translate.usage_totals(answers.select("conv_id", F.col("translated_body").alias("body")), "conv_id")


_WALKED = [
    (1, "anthropic", '{"model":"CORP","max_tokens":2.0,"messages":[{"role":"user","content":"CORP a@b.co"},{"content":[{"type":"image","source":{"data":"CORP"}},{"tool_use_id":"CORP","text":"corp"}]}]}', '{"model":"CORP","max_tokens":2,"messages":[{"role":"user","content":"<CUSTOMER_1A> <EMAIL_1A>"},{"content":[{"type":"image","source":{"data":"x"}},{"tool_use_id":"y","text":"<CUSTOMER_1A>"}]}]}'),
    (2, "openai", '{"x":{"function":{"arguments":"{\\"q\\":\\"CORP\\"}"}}}', '{"x":{"function":{"arguments":"{\\"q\\":\\"<CUSTOMER_1A>\\"}"}}}'),
    (3, "openai", '{"__proto__":1}', None),
    (4, "openai", "no json", None),
]
_WALKED[0] = (1, "anthropic", _WALKED[0][2].replace('"data":"CORP"', '"data":"x"').replace('"tool_use_id":"CORP"', '"tool_use_id":"y"'), _WALKED[0][3])


@_query(_values([(k, m, m is None, False) for k, _, _, m in _WALKED], "id", "masked_body", "error", "leak"))
def q_mask_requests(spark, sf_dir):
    rows = spark.createDataFrame([w[:3] for w in _WALKED], "id long, dialect string, body string")
    return jsonwalk.mask_requests(rows, PARITY).select("id", "masked_body", "error", "leak")


@_query("SELECT event_id, true AS same FROM events")
def q_json_props_roundtrip(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", F.col("props").alias("body"), F.lit("openai").alias("dialect"))
    words = D.parse_dictionary("WORD:\n  patterns: ['[a-z]{3,}']")
    masked = jsonwalk.mask_requests(rows, words).select("event_id", F.col("masked_body").alias("body"), "dialect", "entries", F.col("body").alias("was"))
    plain = lambda c: F.to_json(F.parse_json(F.col(c)))
    return jsonwalk.restore_responses(masked).select("event_id", (plain("restored_body") == plain("was")).alias("same"))


#: Queries over fixed rows: small vectors that tests compare with their expected rows. None is registered; each has a
#: sister that reads a table.
VECTORS = (
    *("q_unmapped_tokens", "q_sanitize", "q_escape_lookalikes", "q_escape_bypass", "q_parity_vectors", "q_commented_terms", "q_dictionary_lint"),
    *("q_dictionary_summary", "q_stop_reason_matrix", "q_admission_status", "q_body_status", "q_ssrf_filter", "q_header_filter", "q_fallback_choice"),
    *("q_sse_parse", "q_sse_format", "q_stream_restore", "q_segments", "q_redact_secrets", "q_scrub_paths", "q_mask_requests", "q_fallbacks_of_dialect"),
)
_PARTS = (table_queries, report_queries, session_queries)


def _every() -> tuple[dict[str, Query], dict[str, str]]:
    found, sql = dict(_QUERIES), dict(_SQL)
    for part in _PARTS:
        found |= part.queries()
        sql |= part.oracle_sql()
    return found, sql


def queries() -> dict[str, Query]:
    return {name: q for name, q in _every()[0].items() if name not in VECTORS}


def oracle_sql() -> dict[str, str]:
    return {name: q for name, q in _every()[1].items() if name not in VECTORS}


def vectors() -> tuple[dict[str, Query], dict[str, str]]:
    """The queries over fixed rows, and their SQL."""
    return tuple({name: q for name, q in every.items() if name in VECTORS} for every in _every())
