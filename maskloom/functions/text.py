"""Column expressions for single strings: cleaning, escaping, look-alikes, small formats."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Invisible characters that cleaning removes, token forms, server folders, names of secrets.
INVISIBLE = r"[\ufeff\u180e\u00ad\u0000\u200b-\u200d\u2060\u202a-\u202e\u2066-\u2069]"
GUARD_INVISIBLE = r"[\ufeff\u0000\u200b-\u200d\u2060\u202a-\u202e\u2066-\u2069]"
TOKEN = r"<[A-Z][A-Z0-9_]*_[0-9]+[A-Z]*>"
LOOK_ALIKE = rf"<{TOKEN}>|{TOKEN}"
SERVER_PATH = r"""/(?:opt|home|root|etc|var|usr|tmp)/[^\s"'`]+"""
SECRET_NAME = r"(?i)TOKEN|KEY|SECRET|PASSWORD|CREDENTIAL"


def sanitized(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def zipped(hits: Column, pieces: Column, replaced) -> Column:
    """pieces[0] + replaced(hits[0]) + pieces[1] + ...: one pass, so what is put in is not searched again."""
    middle = F.zip_with(hits, F.slice(pieces, 2, F.greatest(F.size(hits), F.lit(1))), lambda h, p: F.concat(replaced(h), F.coalesce(p, F.lit(""))))
    return F.when(F.size(hits) > 0, F.concat(F.get(pieces, 0), F.array_join(middle, ""))).otherwise(F.get(pieces, 0))


def escape_look_alikes(text: Column) -> Column:
    """Token look-alikes of an input in double brackets; those that are in double brackets stay."""
    hits = F.regexp_extract_all(text, F.lit(LOOK_ALIKE), F.lit(0))
    return zipped(hits, F.split(text, LOOK_ALIKE, -1), lambda h: F.when(h.startswith("<<"), h).otherwise(F.concat(F.lit("<"), h, F.lit(">"))))


def unescape_look_alikes(text: Column) -> Column:
    return F.regexp_replace(text, rf"<({TOKEN})>", "$1")


def scrub_server_paths(text: Column) -> Column:
    return F.regexp_replace(text, SERVER_PATH, "[REDACTED_PATH]")


def redacted_map(values: Column) -> Column:
    """A map of settings with *** for values whose names speak of secrets."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike(SECRET_NAME), F.lit("***")).otherwise(v))


def clean_header(value: Column) -> Column:
    """A header value: line breaks as spaces, no control characters, no space at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"[\r\n]+", " "), r"[\x00-\x1f\x7f]", ""))


def clean_disposition(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"[\r\n]", ""), r"\.\./", "")


def clean_file_name(name: Column) -> Column:
    """A file name for downloads."""
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[\x00-\x1f\x7f]", ""), r"\.\.+", ""), r"[/\\]", "")
    return F.when(F.trim(flat) == "", F.lit("download")).otherwise(F.trim(flat))


def clean_import_name(name: Column) -> Column:
    """Word characters, dots, hyphens, white space and Hangul only."""
    return F.regexp_replace(name, r"[^A-Za-z0-9_.\s가-힣-]", "")


def time_slug(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmm")


def iso_time(ms: Column) -> Column:
    """Milliseconds since 1970 as 2024-01-31T00:00:00.000Z."""
    return F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def letters(index: Column) -> Column:
    """0 to A, 25 to Z, 26 to AA, up to three letters."""
    one = lambda n: F.chr(F.lit(65) + n)
    two, three = index - 26, index - 26 - 26 * 26
    return (
        F.when(index < 26, one(index % 26))
        .when(index < 26 + 26 * 26, F.concat(one(F.floor(two / 26) % 26), one(two % 26)))
        .otherwise(F.concat(one(F.floor(three / 676) % 26), one(F.floor(three / 26) % 26), one(three % 26)))
    )


def client_ip(forwarded: Column, socket: Column) -> Column:
    """The first of a forwarded list if it is an address, else the socket's, else the local one."""
    first = F.trim(F.get(F.split(forwarded, ","), 0))
    is_ip = first.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?!$)|$)){4}$") | (first.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*$") & (F.length(first) > 1))
    return F.when(F.coalesce(is_ip, F.lit(False)), first).otherwise(F.coalesce(socket, F.lit("127.0.0.1")))


def endpoint_url(base: Column, dialect: Column, own_path: Column) -> Column:
    """An endpoint with the provider's own path for a dialect, or the usual one."""
    usual = F.when(dialect == "anthropic", "/v1/messages").when(dialect == "responses", "/v1/responses").otherwise("/v1/chat/completions")
    return F.concat(F.regexp_replace(base, "/+$", ""), F.coalesce(own_path, usual))


def masked_label(entity: Column, term: Column) -> Column:
    return F.concat(entity, F.lit(" · "), F.length(term).cast("string"), F.lit(" chars"))


def sse_event(event: Column, data: Column, event_id: Column, retry: Column) -> Column:
    """A server-sent event: names on one line, data line by line, a retry of at least 0."""
    one_line = lambda c: F.regexp_replace(c, r"[\r\n]", "")
    lines = F.transform(F.split(data, r"\r\n|\r|\n", -1), lambda x: F.concat(F.lit("data: "), x))
    return F.concat(
        F.concat_ws("\n", F.concat(F.lit("event: "), one_line(event)), F.concat(F.lit("id: "), one_line(event_id)), F.concat(F.lit("retry: "), F.greatest(F.floor(retry), F.lit(0)).cast("string")), F.array_join(lines, "\n")),
        F.lit("\n\n"),
    )


def event_text(data: str, name: str | None = None) -> str:
    """A server-sent event of one line of data, for functions over single streams."""
    return (f"event: {name}\n" if name else "") + f"data: {data}\n\n"


def redacted_json(body: Column) -> Column:
    """A JSON object with *** for values whose names speak of secrets, at any depth of objects; lists stay as they
    are. Null if it is no JSON."""
    return _redacted_json(body)


def _without_secrets(node):
    if not isinstance(node, dict):
        return node
    return {k: "***" if _SECRET.search(k) else _without_secrets(v) for k, v in node.items()}


_SECRET = re.compile(SECRET_NAME)


@F.arrow_udf(T.StringType())
def _redacted_json(body: pa.Array) -> pa.Array:
    out = []
    for text in body.to_pylist():
        try:
            out.append(None if text is None else json.dumps(_without_secrets(json.loads(text)), ensure_ascii=False, separators=(",", ":")))
        except ValueError:
            out.append(None)
    return pa.array(out, pa.string())
