"""Masking the strings of JSON requests.

Python takes the strings out of a body and puts them back; terms are found in each string for itself, and
the strings of a request, in the order of the walk, are one session. A body that breaks a limit has an error and no result.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.functions.parts import by_parts, ranges, release_memory
from maskloom.operators import guard, masking
from maskloom.sources.dictionary import Dictionary

# Limits of a walk, forbidden keys, keys whose values stay as they are.
MAX_DEPTH, MAX_NODES, MAX_KEYS, MAX_KEY_CHARS = 32, 100_000, 10_000, 1024
FORBIDDEN_KEYS = ("__proto__", "constructor", "prototype")
ANTHROPIC_SKIPPED = ("model", "id", "type", "role", "stop_reason", "stop_sequence", "max_tokens", "temperature", "top_p", "top_k", "stream")
OPENAI_SKIPPED = ("model", "role", "finish_reason", "id", "object", "created", "temperature", "max_tokens", "max_completion_tokens", "top_p", "frequency_penalty", "presence_penalty", "stream", "n", "seed")


class WalkError(ValueError):
    """A body that is not walked."""


def field_rule(dialect: str, path: list) -> str:
    """tokenize, skip or json-string for the value at path."""
    key = path[-1] if path else 0
    if isinstance(key, int):
        return "tokenize"
    anthropic = dialect == "anthropic"
    if key.endswith("_id") or key in (ANTHROPIC_SKIPPED if anthropic else OPENAI_SKIPPED):
        return "skip"
    if anthropic:
        return "skip" if key == "data" and path[-2:-1] == ["source"] else "tokenize"
    return "json-string" if key == "arguments" else "tokenize"


def walk(node, dialect: str, change: Callable[[str], str], path: list | None = None, count: list | None = None):
    """node with change() applied to its strings, depth first."""
    path, count = path or [], count if count is not None else [0]
    count[0] += 1
    if len(path) > MAX_DEPTH or count[0] > MAX_NODES:
        raise WalkError("too deep or too large")
    if path and field_rule(dialect, path) == "skip":
        return node
    if isinstance(node, str):
        if path and field_rule(dialect, path) == "json-string":
            try:
                return dumps(walk(json.loads(node), dialect, change, [*path[:-1], 0], count))
            except ValueError:
                pass
        return change(node)
    if isinstance(node, list):
        return [walk(x, dialect, change, [*path, k], count) for k, x in enumerate(node)]
    if isinstance(node, dict):
        if len(node) > MAX_KEYS or any(len(k) > MAX_KEY_CHARS or k in FORBIDDEN_KEYS for k in node):
            raise WalkError("keys")
        return {k: walk(x, dialect, change, [*path, k], count) for k, x in node.items()}
    return node


def _plain_numbers(x):
    if isinstance(x, float) and x.is_integer() and abs(x) < 1e21:
        return int(x)
    if isinstance(x, list):
        return [_plain_numbers(v) for v in x]
    if isinstance(x, dict):
        whole = sorted((k for k in x if k.isdigit() and (k == "0" or k[0] != "0") and int(k) < 2**32 - 1), key=int)
        return {k: _plain_numbers(x[k]) for k in [*whole, *(k for k in x if k not in whole)]}
    return x


def dumps(x) -> str:
    """JSON without spaces, whole numbers without a fraction, index-like keys first."""
    return json.dumps(_plain_numbers(x), ensure_ascii=False, separators=(",", ":"))


def strings_of(body: str | None, dialect: str) -> list[str] | None:
    out: list[str] = []
    try:
        walk(json.loads(body), dialect, lambda s: out.append(s) or s)
    except (ValueError, TypeError, RecursionError):
        return None
    return out


def with_strings(body: str | None, dialect: str, strings: list[str] | None) -> str | None:
    if body is None or strings is None:
        return None
    following = iter(strings)
    out = dumps(walk(json.loads(body), dialect, lambda _: next(following)))
    if next(following, None) is not None:
        raise ValueError("more strings than the body has")
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
@by_parts
def json_strings(body: pa.Array, dialect: pa.Array) -> pa.Array:
    return pa.array([strings_of(b, d) for b, d in zip(body.to_pylist(), dialect.to_pylist(), strict=True)], pa.list_(pa.string()))


def put_back(df: DataFrame, strings: str, out: str) -> DataFrame:
    """df with the string column out: body with its strings replaced by those of the array column strings."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.StringType())])

    def run(batches):
        for b in (whole.slice(*at) for whole in batches for at in ranges(whole.num_rows)):
            columns = {n: b.column(n) for n in b.schema.names if n != out}
            rows = zip(*(b.column(n).to_pylist() for n in ("body", "dialect", strings)), strict=True)
            columns[out] = pa.array([with_strings(*r) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        release_memory()

    return df.mapInArrow(run, schema)


def mask_requests(requests: DataFrame, dictionary: Dictionary) -> DataFrame:
    """requests(body, dialect, ...) with masked_body, entries, max_group, hits, leak and error.

    masked_body is null where the body could not be walked (error) or where the check of its messages,
    system, prompt and input finds a term (leak)."""
    rows = masking.mask_strings(requests.withColumn("__strings", json_strings("body", "dialect")), "__strings", dictionary)
    rows = put_back(rows, "masked", "masked_body")
    scope = F.concat_ws("\n", *(F.get_json_object("masked_body", f"$.{k}") for k in guard.GUARDED_KEYS))
    rows = rows.withColumns({"error": F.col("__strings").isNull(), "leak": guard.leak(scope, dictionary)})
    return rows.withColumn("masked_body", F.when(~F.col("leak"), F.col("masked_body"))).drop("__strings", "masked", "bypassed", "bypassed_surfaces")


def restore_responses(responses: DataFrame) -> DataFrame:
    """responses(body, dialect, entries) with restored_body: known tokens in strings as their terms. A body that is
    no JSON is restored as text; one without a token is passed on as it is."""
    rows = responses.withColumn("__strings", json_strings("body", "dialect"))
    rows = rows.withColumn("__texts", F.coalesce("__strings", F.array("body")))
    rows = masking.restore_strings(rows, "__texts", "entries")
    rows = rows.withColumn("__parts", F.when((F.col("restored") > 0) & F.col("__strings").isNotNull(), F.col("restored_text")))
    rows = put_back(rows, "__parts", "restored_body")
    text = F.when(F.col("restored") == 0, F.col("body")).when(F.col("__strings").isNull(), F.get("restored_text", F.lit(0))).otherwise(F.col("restored_body"))
    return rows.withColumn("restored_body", text).drop("__strings", "__texts", "__parts", "restored_text", "restored")
