"""Operator 9: derivatives of WARC responses.

Each response record gives one metadata record (source headers, digests, title, outlinks) and, if its
payload is text, one conversion record with the plain text. Both name the response by WARC-Refers-To
and keep its target, date and payload digest. A record is a row; derivation is row-local.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Identifiers are version-5 UUIDs in this name space, so reruns give the same ones.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:maskloom:warc")
TEXT_TYPES = ("text/html", "application/xhtml+xml", "text/plain")
_FIELDS = [("warc_type", "string"), ("record_id", "string"), ("refers_to", "string"), ("target_uri", "string"), ("date", "string"), ("content_type", "string"), ("content_length", "bigint"), ("block_digest", "string"), ("source_payload_digest", "string"), ("source_digest_ok", "boolean"), ("block", "binary")]
RECORD = T.StructType([T.StructField(k, {"string": T.StringType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}[t]) for k, t in _FIELDS])
_RECORD = pa.struct([(k, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for k, t in _FIELDS])

#: Elements that show nothing, elements that begin a line, elements that lead elsewhere.
UNSEEN = frozenset(("script", "style", "noscript", "template", "head"))
BREAKS = frozenset(
    "address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul body html".split()
)
LINKED = frozenset(("a", "area", "link", "img", "script", "iframe"))
_NAME = re.compile(r"(/?)([A-Za-z]\w*)|[!?]", re.A)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in UNSEEN}
_TITLE_END = re.compile("</title", re.I)
#: Parts of a tag, with the white space of markup.
_BETWEEN, _ATTRIBUTE = re.compile(r"[ \t\n\f\r/]*"), re.compile(r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*")
#: The rest of a tag whose quotes are pairs behind "=" without a bracket inside; other tags are read part by part.
_PAIRED = re.compile(r"(?:[^\"'>]*=[ \t\n\f\r]*(?:\"[^\">]*\"|'[^'>]*'))*+[^\"'>]*+>")
_EQUALS, _BARE = re.compile(r"[ \t\n\f\r]*=[ \t\n\f\r]*"), re.compile(r"[^ \t\n\f\r>]*")
_META_CHARSET = re.compile(rb"<meta\b[^>]*?charset\s*=\s*[\"']?([A-Za-z0-9_:.-]+)", re.I)
_BLANKS = re.compile(r"[^\S\n]+")


def digest_of(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(p or '' for p in parts))}>"


def split_http(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """(status, headers, payload) of an HTTP response; a block without a status line is all payload."""
    if not block.startswith(b"HTTP/"):
        return None, [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("latin-1").split("\r\n")
    status = first.split(" ")[1] if " " in first else ""
    headers: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in " \t" and headers:
            headers[-1] = headers[-1][0], headers[-1][1] + " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
    return int(status) if status.isdigit() else None, headers, payload


def decoded(payload: bytes, content_type: str) -> tuple[str, str]:
    """(text, character set): of the header, else of a meta element near the start, else UTF-8; bytes that
    don't fit become U+FFFD."""
    m = re.search(r"charset\s*=\s*[\"']?([A-Za-z0-9_:.-]+)", content_type, re.I)
    name = m[1] if m else (x[1].decode() if (x := _META_CHARSET.search(payload[:4096])) else "utf-8")
    try:
        return payload.decode(name, "replace"), name.lower()
    except LookupError:
        return payload.decode("utf-8", "replace"), "utf-8"


def attributes(markup: str, at: int) -> tuple[int, dict[str, str]]:
    """(end of the tag, its attributes) from behind a tag's name: names in lower case, of several with one name the first;
    a bracket inside of a quoted value ends no tag. The end is -1 where the tag or a quote has none."""
    found: dict[str, str] = {}
    while (at := _BETWEEN.match(markup, at).end()) < len(markup):
        if markup[at] == ">":
            return at + 1, found
        name = _ATTRIBUTE.match(markup, at)
        at, value = name.end(), ""
        if m := _EQUALS.match(markup, at):
            at = m.end()
            if markup[at : at + 1] in ('"', "'"):
                close = markup.find(markup[at], at + 1)
                if close < 0:
                    break
                value, at = markup[at + 1 : close], close + 1
            else:
                bare = _BARE.match(markup, at)
                value, at = bare[0], bare.end()
        found.setdefault(name[0].lower(), value)
    return -1, found


def tags(markup: str) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, name in lower case, whether it closes) of each tag, from its bracket to the next closing one outside of
    quoted values; comments have the name "!--" and reach to their end. A tag without an end, as of an open quote, has the
    rest of the markup in it and is the last one. One pass: nothing is looked at more than twice."""
    at = 0
    while (start := markup.find("<", at)) >= 0:
        if markup.startswith("<!--", start):
            end = markup.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(markup)
            yield start, at, "!--", False
            continue
        m = _NAME.match(markup, start + 1)
        if not m:
            at = start + 1
            continue
        if not m[2]:
            end = markup.find(">", m.end()) + 1
        else:
            paired = _PAIRED.match(markup, m.end())
            end = paired.end() if paired else attributes(markup, m.end())[0]
        at = end if end > 0 else len(markup)
        yield start, at, (m[2] or "").lower(), m[1] == "/"


def plain_text(markup: str) -> str:
    """Visible text: a line for each block element, runs of white space as one space, no empty lines. Without their
    closing tag, elements that show nothing reach to the end."""
    out, at = [], 0
    for start, end, name, closes in tags(markup):
        if start < at:
            continue  # inside of what is not shown
        out.append(markup[at:start].replace("\n", " "))
        at = end
        if name in UNSEEN and not closes:
            m = _CLOSE[name].search(markup, end)
            at = m.end() if m else len(markup)
        out.append(" " if name == "!--" or at != end or (name in UNSEEN and not closes) else "\n" if name in BREAKS else "")
    out.append(markup[at:].replace("\n", " "))
    lines = (_BLANKS.sub(" ", line).strip() for line in html.unescape("".join(out)).split("\n"))
    return "\n".join(line for line in lines if line)


def title_of(markup: str) -> str | None:
    """What the first title element holds, if it is closed."""
    for _, end, name, closes in tags(markup):
        if name == "title" and not closes:
            m = _TITLE_END.search(markup, end)
            return " ".join(html.unescape(markup[end : m.start()]).split()) if m else None
    return None


def outlinks(markup: str) -> list[tuple[str, str]]:
    """(element, target) of links outside comments, each once, in their order."""
    found: dict[tuple[str, str], None] = {}
    for start, end, name, closes in tags(markup):
        if name in LINKED and not closes:
            has = attributes(markup, start + 1 + len(name))[1] if markup[end - 1] == ">" else {}
            target = html.unescape(has.get("href") or has.get("src") or "").strip()
            if target and not re.search(r"[\r\n]", target):
                found[name, target] = None
    return list(found)


def derive_one(record_id: str, target: str | None, date: str | None, block: bytes | None, digest: str | None) -> list[dict]:
    """The derivatives of one response; digest is the payload digest that the response states, or null."""
    status, headers, payload = split_http(block or b"")
    found = digest_of(payload)
    content_type = next((v for k, v in headers if k.lower() == "content-type"), "")
    kind = content_type.partition(";")[0].strip().lower() or ("text/html" if payload.lstrip()[:1] == b"<" else "application/octet-stream")
    shared = {"refers_to": record_id, "target_uri": target, "date": date, "source_payload_digest": digest or found, "source_digest_ok": digest is None or digest == found}
    ids = {k: identifier(record_id, k) for k in ("metadata", "conversion")}
    lines = [("http-status", str(status) if status is not None else "-"), ("payload-length", str(len(payload))), ("payload-type", kind)]
    lines += [(f"http-header-{k.lower()}", v) for k, v in headers]
    out = []
    if kind in TEXT_TYPES:
        markup, charset = decoded(payload, content_type)
        text = markup if kind == "text/plain" else plain_text(markup)
        body = text.encode("utf-8", "replace")
        out.append(shared | {"warc_type": "conversion", "record_id": ids["conversion"], "content_type": "text/plain; charset=utf-8", "content_length": len(body), "block_digest": digest_of(body), "block": body})
        lines += [("charset", charset), ("conversion", ids["conversion"])]
        if kind != "text/plain":
            if (title := title_of(markup)) is not None:
                lines.append(("title", title))
            lines += [("outlink", f"{link} {element}") for element, link in outlinks(markup)]
    fields = "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "replace")
    return [shared | {"warc_type": "metadata", "record_id": ids["metadata"], "content_type": "application/warc-fields", "content_length": len(fields), "block_digest": digest_of(fields), "block": fields}, *out]


def serialized(record: dict) -> bytes:
    """A record of derive() as it stands in a WARC file."""
    head = [("WARC-Type", record["warc_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Refers-To", record["refers_to"]), ("WARC-Target-URI", record["target_uri"]), ("WARC-Date", record["date"]), ("WARC-Block-Digest", record["block_digest"]), ("Content-Type", record["content_type"]), ("Content-Length", record["content_length"])]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + record["block"] + b"\r\n\r\n"


@F.arrow_udf(T.ArrayType(RECORD))
def _derive(record_id: pa.Array, target: pa.Array, date: pa.Array, block: pa.Array, digest: pa.Array) -> pa.Array:
    columns = (x.to_pylist() for x in (record_id, target, date, block, digest))
    return pa.array([derive_one(*row) for row in zip(*columns, strict=True)], pa.list_(_RECORD))


@F.arrow_udf(T.BinaryType())
def _serialized(record: pa.Array) -> pa.Array:
    return pa.array([serialized(x) for x in record.to_pylist()], pa.binary())


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of pages(page_id, url, html): page_id, warc_type, record_id, target_uri, date, block,
    payload_digest. Null markup is an empty payload; rows that are equal get equal identifiers."""

    @F.arrow_udf(T.StructType([T.StructField(k, T.StringType() if k != "block" else T.BinaryType()) for k in ("record_id", "block", "payload_digest")]))
    def build(page_id: pa.Array, url: pa.Array, markup: pa.Array) -> pa.Array:
        out = []
        for k, u, m in zip(page_id.to_pylist(), url.to_pylist(), markup.to_pylist(), strict=True):
            body = (m or "").encode()
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nServer: archive\r\n\r\n".encode()
            digest = digest_of(body)
            out.append({"record_id": identifier(str(k), u, digest, "response"), "block": head + body, "payload_digest": digest})
        return pa.array(out, pa.struct([("record_id", pa.string()), ("block", pa.binary()), ("payload_digest", pa.string())]))

    built = pages.select("page_id", "url", build("page_id", "url", "html").alias("r"))
    return built.select("page_id", F.lit("response").alias("warc_type"), "r.record_id", F.col("url").alias("target_uri"), F.lit(date).alias("date"), "r.block", "r.payload_digest")


def derive(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The derivative records of the responses among records(warc_type, record_id, target_uri, date, block,
    payload_digest), with the columns named by keep. Records of another type give none. A null block is an
    empty one, a null target is left out of the record's header, repeated rows give repeated records."""
    rows = records.filter("warc_type = 'response'").select(*keep, F.explode(_derive("record_id", "target_uri", "date", "block", "payload_digest")).alias("record"))
    return rows.select(*keep, "record.*")


def with_bytes(derived: DataFrame) -> DataFrame:
    """derive()'s rows with the column warc: the bytes that a WARC file holds for the record."""
    return derived.withColumn("warc", _serialized(F.struct(*[k for k, _ in _FIELDS])))


def derivatives(pages: DataFrame) -> DataFrame:
    """Of each page its metadata and conversion record, the block as text."""
    return derive(responses(pages), keep=("page_id",)).withColumn("block", F.decode("block", "UTF-8"))
