"""Sessions of many rows: one token for a term in all rows of a session, numbered by first appearance.

A session's tokens depend on the order in which its terms first appear, but not on the texts between them. So
spans are found row by row, the first place of each term of a session is an aggregation, and numbers come from running
counts over ranges of these first places; no task holds a session, whatever its size.

What is numbered of an entity are two kinds of terms. Those of the dictionary bring a number of their own
(group and alias), which lifts the counter to it; each bears its own token unless that is taken. All others, hits of
patterns and further spellings of one dictionary term, take the counter's next number. The dictionary bounds how
many bring a number, so the places where they lift the counter are few for each entity of a session and are
found by one fold over them; between two of them numbers just follow each other.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.functions.text import escape_look_alikes, sanitized
from maskloom.operators.masking import _DOUBLE, TOKEN_FORMAT, Finder, rendered, token_pattern
from maskloom.sources.dictionary import Dictionary
from maskloom.sources.written import saved

#: A mapping of at most so many rows is broadcast to the rows of a table.
BROADCAST_ROWS = 200_000
_SPAN = "struct<start:int,end:int,entity:string,surface:string,suffix:string,kept:boolean>"
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity", pa.string()), ("surface", pa.string()), ("suffix", pa.string()), ("kept", pa.bool_())]))
_STEP = T.StructType([T.StructField(n, T.StringType() if n == "key" else T.LongType()) for n in ("before", "shift", "key", "number")])
_STEPS_ARROW = pa.list_(pa.struct([("before", pa.int64()), ("shift", pa.int64()), ("key", pa.string()), ("number", pa.int64())]))


def _found(df: DataFrame, text: str, dictionary: Dictionary, escape: bool) -> DataFrame:
    """df with __clean and __spans; kept: behind a backslash, which keeps a surface as it is."""
    find, names = Finder(dictionary), ("start", "end", "entity", "surface", "suffix")

    @F.arrow_udf(f"array<{_SPAN}>")
    def spans(texts: pa.Array) -> pa.Array:
        out, before = [], lambda t, x: t[x[0] - 1 : x[0]]
        for t in texts.to_pylist():
            out.append([{**dict(zip(names, x, strict=True)), "kept": escape and before(t, x) == "\\"} for x in find(t)])
        return pa.array(out, _SPANS_ARROW)

    rows = df.withColumn("__clean", escape_look_alikes(sanitized(F.col(text))))
    return rows.withColumn("__spans", spans(F.col("__clean")))


def _first_places(found: DataFrame) -> DataFrame:
    """__session, entity, key, at, surface, suffix: where a term of a session appears first. A key is a term in lower case."""
    place = F.struct("__order", F.xxhash64("__clean").alias("text"), F.col("x.start").alias("start"))
    rows = found.select("__session", "__order", "__clean", F.explode("__spans").alias("x")).filter("NOT x.kept")
    rows = rows.select("__session", "x.entity", F.lower("x.surface").alias("key"), place.alias("at"), F.struct("x.surface", "x.suffix").alias("of"))
    rows = rows.groupBy("__session", "entity", "key").agg(F.min(F.struct("at", "of")).alias("first"))
    return rows.select("__session", "entity", "key", "first.at", "first.of.surface", "first.of.suffix")


def _kinds(places: DataFrame) -> DataFrame:
    """places with own: whether a term brings its number; of several spellings of a dictionary term the first one does."""
    same = W.partitionBy("__session", "entity", "suffix").orderBy("at")
    named = places.filter("suffix IS NOT NULL").withColumn("own", F.row_number().over(same) == 1)
    return named.unionByName(places.filter("suffix IS NULL").withColumn("own", F.lit(False)))


def _counted(kinds: DataFrame) -> DataFrame:
    """kinds with counted: how many terms of the entity that take the counter's number are up to here, itself included."""
    order = ("__session", "entity", "at")
    ranges = saved(kinds.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "session-terms")
    takes = F.when(F.col("own"), 0).otherwise(1).cast("long")
    # a row for each entity of a session and range; ranges are few
    sums = ranges.groupBy("__session", "entity", "part").agg(F.sum(takes).alias("n"))
    earlier = W.partitionBy("__session", "entity").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("__session", "entity", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    within = W.partitionBy("__session", "entity", "part").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    rows = ranges.withColumn("counted", F.sum(takes).over(within))
    same = rows["__session"].eqNullSafe(sums["__session"]) & (rows["entity"] == sums["entity"]) & (rows["part"] == sums["part"])
    return rows.join(sums, same).select(*(rows[c] for c in kinds.columns), (F.col("counted") + F.col("earlier")).alias("counted"))


@F.arrow_udf(T.ArrayType(_STEP))
def _steps(terms: pa.Array) -> pa.Array:
    """Of an entity's terms that bring a number, in order, as (counted, group, whether the first alias, key): by how much the
    counter is ahead of the count behind each, and the number that a term gets whose own token is taken."""
    out = []
    for row in terms:
        shift, seen, starts, ends, steps = 0, 0, [], [], []
        for x in row.as_py():
            r, group, number = x["counted"], x["group"], None
            if r > seen:  # numbers given since the last step
                starts.append(seen + shift + 1)
                ends.append(r + shift)
                seen = r
            k = bisect_right(starts, group) - 1
            if x["first_alias"] and k >= 0 and group <= ends[k]:
                shift += 1
                number = r + shift
                starts.append(number)
                ends.append(number)
            else:
                shift = max(shift, group - r)
            steps.append({"before": r, "shift": shift, "key": x["key"], "number": number})
        out.append(steps)
    return pa.array(out, _STEPS_ARROW)


def _numbered(counted: DataFrame, token_format: str) -> DataFrame:
    """__session, entity, key, token, term."""
    group = F.regexp_extract("suffix", "^[0-9]+", 0).cast("long")
    own = counted.filter("own").select("__session", "entity", F.struct("at", "counted", group.alias("group"), F.col("suffix").rlike("^[0-9]+A$").alias("first_alias"), "key").alias("x"))
    lists = own.groupBy("__session", "entity").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    steps = lists.select(F.col("__session").alias("__of"), F.col("entity").alias("__entity"), _steps(F.transform("xs", lambda x: F.struct(x["counted"].alias("counted"), x["group"].alias("group"), x["first_alias"].alias("first_alias"), x["key"].alias("key")))).alias("steps"))
    rows = counted.join(steps, F.col("__session").eqNullSafe(F.col("__of")) & (F.col("entity") == F.col("__entity")), "left")
    behind = F.filter("steps", lambda s: s["before"] < F.col("counted"))
    shift = F.coalesce(F.get(behind, F.size(behind) - 1)["shift"], F.lit(0))
    renamed = F.get(F.filter("steps", lambda s: s["key"] == F.col("key")), F.lit(0))["number"]
    number = F.when(F.col("own"), renamed).otherwise(F.col("counted") + shift)
    n = F.when(number.isNull(), F.col("suffix")).otherwise(F.concat(number.cast("string"), F.lit("A")))
    return rows.select("__session", "entity", "key", _rendered(F.col("entity"), n, token_format).alias("token"), F.col("surface").alias("term"))


def _rendered(entity: Column, n: Column, token_format: str) -> Column:
    """rendered() of columns; neither brackets nor names hold the marks themselves."""
    parts = re.split(r"(\{type\}|\{n\})", rendered("{type}", "{n}", token_format))
    return F.concat(*(entity if p == "{type}" else n if p == "{n}" else F.lit(p) for p in parts if p))


def _known(rows: DataFrame, wanted: Column, mapping: DataFrame, on: list[str], value: str) -> DataFrame:
    """rows(__row, __session, ...) with __known: a map from the strings of the array wanted to what mapping(__session, on...,
    value) gives for them in the session. A string that very many rows want is dealt over tasks: a small mapping is broadcast,
    for a large one Spark splits what is too much for a task."""
    of = mapping.select(F.col("__session").alias("__of"), F.concat_ws("\0", *on).alias("__name"), F.col(value).alias("__value"))
    if mapping.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        of = F.broadcast(of)
    names = rows.select("__row", "__session", F.explode(F.array_distinct(wanted)).alias("__name"))
    hits = names.join(of, names["__session"].eqNullSafe(of["__of"]) & (names["__name"] == of["__name"])).select("__row", names["__name"], "__value")
    maps = hits.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("__name", "__value"))).alias("__known"))
    return rows.join(maps, "__row", "left")


@F.arrow_udf(T.StringType())
def _replaced(texts: pa.Array, spans: pa.Array, known: pa.Array) -> pa.Array:
    """Texts with the tokens of their spans."""
    out = []
    for text, row, tokens in zip(texts.to_pylist(), spans, known, strict=True):
        if text is None:
            out.append(None)
            continue
        tokens, parts, at = dict(tokens.as_py() or ()), [], 0
        for x in row.as_py():
            if x["kept"]:
                parts += [text[at : x["start"] - 1], x["surface"]]
            else:
                parts += [text[at : x["start"]], tokens[f"{x['entity']}\0{x['key']}"]]
            at = x["end"]
        out.append("".join(parts) + text[at:])
    return pa.array(out, pa.string())


def mask_sessions(df: DataFrame, text: str, session: str, order: str, dictionary: Dictionary, token_format: str = TOKEN_FORMAT, escape: bool = False) -> tuple[DataFrame, DataFrame]:
    """(df with masked, mapping(session, token, entity, term)).

    Rows with the same session share their tokens, in the order of `order`, nulls first; rows of one place are taken by their
    texts, so that equal tables give equal tokens. Null sessions are one session. Null texts stay null and have no
    span; a column masked is replaced. Tokens are those that one session over the texts in this order gives.
    escape: a backslash before a span keeps its surface and goes.
    """
    rows = df.withColumns({"__session": F.col(session), "__order": F.col(order), "__row": F.monotonically_increasing_id()})
    found = saved(_found(rows, text, dictionary, escape), "session-rows")
    tokens = saved(_numbered(_counted(_kinds(_first_places(found))), token_format), "session-tokens")
    spans = F.transform("__spans", lambda x: x.withField("key", F.lower(x["surface"])))
    wanted = F.transform(F.filter(spans, lambda x: ~x["kept"]), lambda x: F.concat_ws("\0", x["entity"], x["key"]))
    out = _known(found, wanted, tokens, ["entity", "key"], "token").withColumn("masked", _replaced(F.col("__clean"), spans, F.col("__known")))
    mapping = tokens.select(F.col("__session").alias(session), "token", "entity", "term")
    return out.select(*(c for c in df.columns if c != "masked"), "masked"), mapping


def restore_sessions(df: DataFrame, masked: str, session: str, mapping: DataFrame, token_format: str = TOKEN_FORMAT) -> DataFrame:
    """df with restored_text and restored: known tokens of a row's session as their terms, in one pass, unknown ones as
    they are, then double brackets as single ones; restored counts the known tokens. mapping(session, token, term)
    has each token of a session once."""
    pattern = token_pattern(token_format)

    @F.arrow_udf("array<string>")
    def tokens_of(texts: pa.Array) -> pa.Array:
        return pa.array([pattern.findall(t or "") for t in texts.to_pylist()], pa.list_(pa.string()))

    @F.arrow_udf("struct<restored_text:string,restored:bigint>")
    def terms(texts: pa.Array, known: pa.Array) -> pa.Array:
        out = []
        for text, entries in zip(texts.to_pylist(), known, strict=True):
            by_token = dict(entries.as_py() or ())
            n = sum(t in by_token for t in pattern.findall(text or ""))
            out.append({"restored_text": None if text is None else _DOUBLE.sub(r"\1", pattern.sub(lambda m, k=by_token: k.get(m[0], m[0]), text)), "restored": n})
        return pa.array(out, pa.struct([("restored_text", pa.string()), ("restored", pa.int64())]))

    rows = df.withColumns({"__session": F.col(session), "__row": F.monotonically_increasing_id(), "__tokens": tokens_of(F.col(masked))})
    rows = saved(rows, "session-restore")
    found = _known(rows, F.col("__tokens"), mapping.withColumn("__session", F.col(session)), ["token"], "term")
    found = found.withColumn("__back", terms(F.col(masked), F.col("__known")))
    return found.select(*(c for c in df.columns if c not in ("restored_text", "restored")), "__back.*")


def max_groups(mapping: DataFrame, session: str, token_format: str = TOKEN_FORMAT) -> DataFrame:
    """session, entity, max_group: the highest number among the tokens of an entity of a session."""
    before, _, rest = token_format.partition("{type}")
    middle = rest.partition("{n}")[0]
    start = F.length("entity") + len(before) + len(middle) + 1
    number = F.regexp_extract(F.substring("token", start, F.length("token")), "^[0-9]+", 0).cast("int")
    return mapping.groupBy(session, "entity").agg(F.max(number).alias("max_group"))
