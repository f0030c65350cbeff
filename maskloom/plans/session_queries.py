"""Queries of sessions over many rows, large dictionaries and rules, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import offsets
from maskloom.operators import guard, mappings, masking, matchers, rules, sessions, typedwalk
from maskloom.sources import dictionary as D
from maskloom.sources import event_files
from maskloom.sources.written import shared_dir

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


#: Words of one ending as a pattern: a conversation has hundreds of them, in several cases.
WORDS = D.parse_dictionary("WORD:\n  patterns: ['[A-Za-z]+tion']")
_NUMBERED = """
  h AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[A-Za-z]+tion') AS hits, string_split_regex(text, '[A-Za-z]+tion') AS pieces FROM conversations),
  x AS (SELECT conv_id, turn, unnest(range(1, len(hits) + 1)) AS i, hits FROM h),
  s AS (SELECT conv_id, turn, i, hits[i] AS surface, lower(hits[i]) AS key FROM x),
  k AS (SELECT conv_id, key, arg_min(surface, (turn, i)) AS term, min((turn, i)) AS place FROM s GROUP BY conv_id, key),
  n AS (SELECT conv_id, key, term, '<WORD_' || row_number() OVER (PARTITION BY conv_id ORDER BY place) || 'A>' AS token FROM k)
"""


def _rebuilt(value: str) -> str:
    """Each turn with a value in place of its hits."""
    return f"""SELECT h.conv_id, h.turn, h.pieces[1] || coalesce(string_agg({value} || h.pieces[s.i + 1], '' ORDER BY s.i), '') AS said
    FROM h LEFT JOIN s ON s.conv_id = h.conv_id AND s.turn = h.turn LEFT JOIN n ON n.conv_id = s.conv_id AND n.key = s.key GROUP BY h.conv_id, h.turn, h.pieces[1]"""


@_query(f"WITH {_NUMBERED} {_rebuilt('n.token')}")
def q_mask_sessions(spark, sf_dir):
    """Turns as rows: a word has one token in all turns of a conversation."""
    rows, _ = sessions.mask_sessions(_table(spark, sf_dir, "conversations"), "text", "conv_id", "turn", WORDS)
    return rows.select("conv_id", "turn", F.col("masked").alias("said"))


@_query(f"WITH {_NUMBERED} SELECT conv_id, token, 'WORD' AS entity, term FROM n")
def q_session_mappings(spark, sf_dir):
    return sessions.mask_sessions(_table(spark, sf_dir, "conversations"), "text", "conv_id", "turn", WORDS)[1]


@_query(f"WITH {_NUMBERED}, r AS ({_rebuilt('n.term')}) SELECT r.conv_id, r.turn, r.said, CAST(coalesce(c.n, 0) AS BIGINT) AS restored FROM r LEFT JOIN (SELECT conv_id, turn, count(*) AS n FROM s GROUP BY conv_id, turn) c ON c.conv_id = r.conv_id AND c.turn = r.turn")
def q_restore_sessions(spark, sf_dir):
    """Masked turns joined with their conversation's mapping: a word comes back as it was first written."""
    rows, mapping = sessions.mask_sessions(_table(spark, sf_dir, "conversations"), "text", "conv_id", "turn", WORDS)
    return sessions.restore_sessions(rows, "masked", "conv_id", mapping).select("conv_id", "turn", F.col("restored_text").alias("said"), "restored")


@_query(
    f"""WITH {_NUMBERED}, e AS (SELECT conv_id, token, term FROM n UNION SELECT conv_id, token, term || '!' FROM n WHERE token = '<WORD_1A>')
  SELECT CAST(conv_id AS VARCHAR) AS session, token, 'WORD' AS entity, term, token = '<WORD_1A>' AS conflict FROM e"""
)
def q_mapping_store(spark, sf_dir):
    """The mappings of all conversations, merged into a store in three overlapping parts; the last one has another term
    for the first token of each, which is a conflict."""
    mapping = sessions.mask_sessions(_table(spark, sf_dir, "conversations"), "text", "conv_id", "turn", WORDS)[1]
    path = f"{shared_dir(spark)}/mappings-{uuid.uuid4().hex}"
    other = mapping.filter("token = '<WORD_1A>'").withColumn("term", F.concat("term", F.lit("!")))
    for part in (mapping.filter(F.col("conv_id") % 2 == 0), mapping, other):
        mappings.upsert(part, path, session="conv_id")
    return mappings.stored(spark, path)


@cache
def _customers() -> D.Dictionary:
    """20,000 terms by a rule: the names of customers."""
    names = [f"Customer#{k:09d}" for k in range(20_000)]
    return D.Dictionary(terms=[D.Term(k, "ODD" if k % 2 else "EVEN", t, t, False, False, f"{k + 1}A") for k, t in enumerate(names)])


@_query(
    """WITH c AS (SELECT c_nationkey, c_custkey, c_custkey % 2 = 0 AS even FROM customer WHERE c_custkey < 20000)
  SELECT c_nationkey, CASE WHEN even THEN 'EVEN' ELSE 'ODD' END AS entity, CAST(2 * count(*) AS BIGINT) AS hits, min('<' || CASE WHEN even THEN 'EVEN' ELSE 'ODD' END || '_' || (c_custkey + 1) || 'A>') AS token FROM c GROUP BY c_nationkey, even"""
)
def q_large_dictionary(spark, sf_dir):
    """20,000 terms at once: each name twice, once in capitals, and once inside of a longer word, where it is none."""
    name = F.col("c_name")
    rows = _table(spark, sf_dir, "customer").select("c_nationkey", F.concat(name, F.lit(" and\t"), F.upper(name), F.lit(", x"), name).alias("text"))
    rows = masking.mask(rows, "text", _customers()).select("c_nationkey", F.explode("hits").alias("entity", "n"), "entries")
    rows = rows.select("c_nationkey", "entity", "n", F.get("entries", F.lit(0))["token"].alias("token"))
    return rows.groupBy("c_nationkey", "entity").agg(F.sum("n").cast("long").alias("hits"), F.min("token").alias("token"))


@_query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'EVEN' ELSE 'ODD' END AS category, CAST(1 AS BIGINT) AS rules FROM orders WHERE o_custkey < 20000")
def q_guard_many_rules(spark, sf_dir):
    """20,000 rules over each order's customer: the plan is that of one rule."""
    text = F.concat(F.lit("for customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("."))
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.explode(guard.leaks(text, _customers())).alias("category", "rules"))


@_query(
    r"""WITH b AS (SELECT item_id AS rule, 'Q' || (item_id % 3) AS category, regexp_extract(text, '[A-Za-z]+ [A-Za-z]+') AS term FROM benchmark)
  SELECT doc_id, category, CAST(count(*) AS BIGINT) AS rules FROM documents, b WHERE term <> '' AND
    regexp_matches(text, '(?i)(^|[^A-Za-z0-9])' || replace(term, ' ', '\s+') || '($|[^A-Za-z0-9])') GROUP BY doc_id, category"""
)
def q_guard_rule_table(spark, sf_dir):
    """Rules from a table, two words of each benchmark item, over all documents."""
    k, term = F.col("item_id"), F.regexp_extract("text", "[A-Za-z]+ [A-Za-z]+", 0)
    table = _table(spark, sf_dir, "benchmark").select(k.alias("rule"), F.concat(F.lit("Q"), (k % 3).cast("string")).alias("category"), term.alias("term"), F.lit(False).alias("strict"))
    return rules.rule_counts(rules.rule_hits(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", table), "doc_id")


_SMILING = r"""
  h AS (SELECT doc_id, regexp_extract_all(t, '[0-9]+') AS hits, string_split_regex(t, '[0-9]+') AS pieces FROM (SELECT doc_id, replace(text, ',', '😀,') AS t FROM documents)),
  x AS (SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, hits, pieces FROM h),
  s AS (SELECT doc_id, list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda q: length(q))), 0) AS start,
    list_sum(list_transform(pieces[1:i], lambda p: length(p) - length(replace(p, '😀', '')))) AS wide,
    list_sum(list_transform(pieces[1:i], lambda p: strlen(p))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda q: strlen(q))), 0) AS bytes FROM x)
"""


@_query(f"WITH {_SMILING} SELECT doc_id, CAST(start AS BIGINT) AS code_point, CAST(start + wide AS BIGINT) AS utf16, CAST(bytes AS BIGINT) AS byte FROM s")
def q_offsets_of_spans(spark, sf_dir):
    """Numbers in texts with a character beyond U+FFFF before each comma: their starts in three units."""
    text = F.replace(F.col("text"), F.lit(","), F.lit("😀,"))
    found = masking.find_spans(_table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "text", D.parse_dictionary("N:\n  patterns: ['[0-9]+']"))
    units = {u: offsets.converted(F.col("text"), F.col("spans"), "code_points", u) for u in ("utf16", "bytes")}
    rows = found.withColumns(units).select("doc_id", F.inline_outer(F.arrays_zip("spans", "utf16", "bytes"))).filter("spans IS NOT NULL")
    return rows.select("doc_id", F.col("spans.start").cast("long").alias("code_point"), F.col("utf16.start").alias("utf16"), F.col("bytes.start").alias("byte"))


@_query(
    r"""SELECT entity, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents FROM (
  SELECT doc_id, 'SECRET' AS entity, unnest(regexp_extract_all(text, '[0-9a-f]{40}')) AS x FROM documents
  UNION ALL SELECT doc_id, 'NUMBER', unnest(regexp_extract_all(regexp_replace(text, '[0-9a-f]{40}', '#', 'g'), '[0-9]+')) FROM documents) GROUP BY entity"""
)
def q_matchers_of_documents(spark, sf_dir):
    """Spans of two matchers as rows; a number inside of a longer span goes."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = {"SECRET": "[0-9a-f]{40}", "NUMBER": "[0-9]+"}
    found = [rows.select("doc_id", F.inline_outer(matchers.of_pattern(e, p)(F.col("text")))).withColumn("rank", F.lit(n)) for n, (e, p) in enumerate(kinds.items())]
    stay = matchers.resolved_rows(found[0].union(found[1]).select("doc_id", "start", "end", "rank", "entity"), "doc_id")
    return stay.groupBy("entity").agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("documents"))


@_query("SELECT role AS event, conv_id || ':' || turn AS id, text AS data FROM conversations")
def q_event_files(spark, sf_dir):
    """All turns written as files of events and read again in ranges of bytes."""
    event_files.register(spark)
    path = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    turns = _table(spark, sf_dir, "conversations")
    key = F.concat_ws(":", "conv_id", "turn")
    turns.select(F.col("role").alias("event"), key.alias("id"), F.col("text").alias("data")).write.format("sse").mode("append").save(path)
    return spark.read.format("sse").option("splitBytes", 1 << 20).load(path).select("event", "id", "data")


@_query(f"WITH {_NUMBERED} {_rebuilt('n.token')}")
def q_typed_walk(spark, sf_dir):
    """Conversations as typed requests, a list of messages with a list of blocks each, masked where they are."""
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", block.alias("content")).alias("m"))
    requests = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("messages"))
    rows = typedwalk.mask_typed(requests, WORDS, "messages")
    return rows.select("conv_id", F.inline("messages")).select("conv_id", "turn", F.get("content", F.lit(0))["text"].alias("said"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
