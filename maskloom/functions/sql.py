"""The masking functions for SQL users: register() names them in a session."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from maskloom.operators import masking
from maskloom.sources.dictionary import Dictionary

_SPAN_DDL = "start int, end int, entity string, surface string"


def register(spark: SparkSession, dictionary: Dictionary, prefix: str = "") -> None:
    """Name in SQL: mask_text(text), the masked text; mask_spans(text), an array of spans for inline();
    restore_text(text, mapping), with a map of tokens to terms; span_rows(text), a table function."""
    find = masking.Finder(dictionary)

    def masked(text: str | None) -> str | None:
        session = masking._Session(masking.TOKEN_FORMAT, False)
        clean = text and session.clean(text)
        return clean and session.masked(clean, find(clean))

    @F.arrow_udf("string")
    def mask_text(text: pa.Array) -> pa.Array:
        return pa.array([masked(t) for t in text.to_pylist()], pa.string())

    @F.arrow_udf(f"array<struct<{_SPAN_DDL.replace(' int', ':int').replace(' string', ':string')}>>")
    def mask_spans(text: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity", pa.string()), ("surface", pa.string())]))
        return pa.array([[dict(zip(("start", "end", "entity", "surface"), x, strict=False)) for x in find(t)] for t in text.to_pylist()], kind)

    @F.arrow_udf("string")
    def restore_text(text: pa.Array, mapping: pa.Array) -> pa.Array:
        from maskloom.streaming.restoring import restored

        return pa.array([None if t is None else restored(t, dict(m or ())) for t, m in zip(text.to_pylist(), mapping.to_pylist(), strict=True)], pa.string())

    class SpanRows:
        """(start, end, entity, surface) of each span of a text."""

        def eval(self, text: str):
            for start, end, entity, surface, _ in find(text):
                yield start, end, entity, surface

    for function in (mask_text, mask_spans, restore_text):
        spark.udf.register(prefix + function.__name__, function)
    spark.udtf.register(f"{prefix}span_rows", F.udtf(SpanRows, returnType=_SPAN_DDL))
