"""Matchers of one's own: anything that gives spans of a text, beside or in place of a dictionary.

A matcher is a function of a text column that gives a column array<struct<start, end, entity, surface, suffix>>: a
dictionary, an expression, a model. Where spans of several matchers overlap, the leftmost goes first, of those that
start at one place the longest, of equal ones that of the earlier matcher. resolved() does so within a row,
resolved_rows() over a relation of spans, where a text may have any number of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.text import escape_look_alikes, sanitized
from maskloom.operators import masking
from maskloom.operators.masking import _MASKED, _MASKED_ARROW, _SPANS_ARROW, SPAN, TOKEN_FORMAT
from maskloom.sources.dictionary import Dictionary

Matcher = Callable[[Column], Column]
_NAMES = ("start", "end", "entity", "surface", "suffix")


def of_dictionary(dictionary: Dictionary) -> Matcher:
    """The terms and patterns of a dictionary."""
    return of_function(masking.Finder(dictionary))


def of_function(find: Callable[[str], Iterable[tuple]]) -> Matcher:
    """A function of one text that gives tuples (start, end, entity, surface, suffix), as spans in code points."""

    def matcher(text: Column) -> Column:
        @F.arrow_udf(f"array<{SPAN}>")
        def spans(texts: pa.Array) -> pa.Array:
            return pa.array([[dict(zip(_NAMES, x, strict=True)) for x in find(t)] if t else [] for t in texts.to_pylist()], _SPANS_ARROW)

        return spans(text)

    return matcher


def of_pattern(entity: str, pattern: str) -> Matcher:
    """The matches of a Python expression, numbered as they come."""
    compiled = re.compile(pattern)
    return of_function(lambda t: ((m.start(), m.end(), entity, m[0], None) for m in compiled.finditer(t) if m[0]))


def _chosen(spans: list[tuple]) -> list[tuple]:
    """Of (start, end, rank, ...) those that stay, in order. Spans without a character are none."""
    out, reach = [], 0
    for x in sorted(spans, key=lambda x: (x[0], -x[1], x[2])):
        if x[0] >= reach and x[1] > x[0]:
            out.append(x)
            reach = x[1]
    return out


def resolved(*spans: Column) -> Column:
    """The spans of several matchers over one text that stay. Null arrays and null spans have no span."""

    @F.arrow_udf(f"array<{SPAN}>")
    def stay(*columns: pa.Array) -> pa.Array:
        out = []
        for row in zip(*columns, strict=True):
            every = [(x["start"], x["end"], rank, x) for rank, one in enumerate(row) for x in one.as_py() or () if x is not None]
            out.append([x[3] for x in _chosen(every)])
        return pa.array(out, _SPANS_ARROW)

    return stay(*spans)


def mask(df: DataFrame, text: str, matchers: Sequence[Matcher], token_format: str = TOKEN_FORMAT, escape: bool = False) -> DataFrame:
    """masking.mask() by the spans of matchers: df with masked, entries, max_group, hits, bypassed and bypassed_surfaces. Null
    texts stay null."""

    @F.arrow_udf(_MASKED)
    def tokens(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for value, row in zip(texts.to_pylist(), spans, strict=True):
            session = masking._Session(token_format, escape)
            found = [tuple(x[n] for n in _NAMES) for x in row.as_py() or ()]
            out.append(session.result([None if value is None else session.masked(value, found)]))
        return pa.array(out, _MASKED_ARROW)

    rows = df.withColumn("__clean", escape_look_alikes(sanitized(F.col(text))))
    rows = rows.withColumn("__done", tokens(F.col("__clean"), resolved(*(m(F.col("__clean")) for m in matchers))))
    rows = rows.select(*(c for c in df.columns if c not in (*(f.name for f in _MASKED_ARROW), "__clean", "__done")), "__done.*")
    return rows.withColumn("masked", F.get("masked", F.lit(0)))


def resolved_rows(spans: DataFrame, *keys: str, rank: str = "rank") -> DataFrame:
    """The rows of spans(keys, start, end, rank, ...) that stay, by the same rule. Rows of one key come sorted, one after the
    other, and only the end of the last span that stayed is kept; they are never gathered. Rows with a null start or end go."""
    good = spans.filter("`end` > start")
    order = [F.col(k) for k in keys] + [F.col("start"), F.col("end").desc(), F.col(rank)]
    # what is left over decides between rows that are equal so far, so that reruns agree
    rest = [F.to_json(F.struct(*(c for c in spans.columns if c not in (*keys, "start", "end", rank))))] if len(spans.columns) > len(keys) + 3 else []
    rows = good.repartition(*keys).sortWithinPartitions(*order, *rest)
    places = [rows.columns.index(c) for c in (*keys, "start", "end")]

    def stay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reach = None, 0
        for batch in batches:
            kept = []
            for *key, start, end in zip(*(batch.column(k).to_pylist() for k in places), strict=True):
                if key != last:
                    last, reach = key, 0
                kept.append(start >= reach)
                reach = end if start >= reach else reach
            yield batch.filter(pa.array(kept, pa.bool_()))

    return rows.mapInArrow(stay, rows.schema)
