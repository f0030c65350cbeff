"""Operator 7: personal data by anchor expansion.

An Aho-Corasick automaton walks each text once and reports anchors: at-signs, scheme marks, digit
groups and identifier cues. Each anchor is expanded by a small deterministic parser that finds the
boundaries of an e-mail address, network address, card or phone number, URL or account number and
validates it. Spans are in code points, end exclusive; within a kind they don't overlap.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds that the contract fixes, and those that this method adds, in the order of the reports.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url", "account")
KINDS = BASE_KINDS + ADDED_KINDS
#: Words before an account number.
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn", "customer id", "user id", "kontonummer", "konto", "compte", "cuenta")

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
SPANS_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DIGIT = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ADDRESS = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HOST_AND_PATH = re.compile(r"[A-Za-z0-9\[][^\s<>\"'`{}|\\^]*")
_ACCOUNT = re.compile(r"(?:[ .]*(?:number|no|nr|id|code|(?i:number|no|nr|id|code)(?![A-Za-z0-9])))?[ .:#=]*([A-Za-z]{0,4}[0-9](?:[ -]?[A-Z0-9]){5,33})(?![A-Za-z0-9])", re.ASCII)
#: For the cues in any case; positions stay.
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


@cache
def _automaton():
    import ahocorasick

    words: dict[str, tuple[str, int]] = {"@": ("email", 0), "://": ("url", 2)}
    digits = "0123456789"
    words |= {f"+{a}": ("phone", 1) for a in digits}
    words |= {f"{a}.{b}": ("ip", 1) for a, b in product(digits, digits)}
    for mark in ("", " ", "-"):
        words |= {f"{a}{mark}{b}": ("card", 1 + len(mark)) for a, b in product(digits, digits)}
    for cue in ACCOUNT_CUES:
        words[cue] = ("account", len(cue) - 1)
    found = ahocorasick.Automaton()
    for word, value in words.items():
        found.add_word(word, value)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _left(text: str, at: int, allowed: frozenset, least: int) -> int:
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def _email(text, at, least):
    start = _left(text, at, _LOCAL, least)
    if start < at and (m := _DOMAIN.match(text, at + 1)):
        return start, m.end(), True
    return None


def _ip(text, at, least):
    start = _left(text, at, _DIGIT, least)
    if start < at and (m := _ADDRESS.match(text, start)):
        return start, m.end(), all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups())
    return None


def _card(text, at, least):
    m = _NUMBER.match(text, at)
    digits = m[0].replace(" ", "").replace("-", "") if m.end() - at <= 37 else ""
    return at, m.end(), 16 <= len(digits) <= 19 and luhn(digits)


def _phone(text, at, least):
    if m := _PHONE.match(text, at):
        n = sum(c in _DIGIT for c in m[0]) if m.end() - at <= 400 else sum(map(m[0].count, _DIGIT))
        return at, m.end(), 8 <= n <= 15
    return None


def _url(text, at, least):
    start = _left(text, at, _SCHEME, least)
    while start < at and not text[start].isalpha():
        start += 1
    if start < at and (m := _HOST_AND_PATH.match(text, at + 3)):
        end = m.end()
        while end > m.start() and text[end - 1] in ".,;:!?)]":
            end -= 1
        return (start, end, True) if end > m.start() else None
    return None


def _iban(number: str) -> bool:
    turned = number[4:] + number[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _account(text, at, least):
    """at is the cue's start; the span is that of the number behind it."""
    if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
        return None
    cue = next(c for c in sorted(ACCOUNT_CUES, key=len, reverse=True) if text[at : at + len(c)].lower() == c)
    if m := _ACCOUNT.match(text, at + len(cue)):
        number = m[1].replace(" ", "").replace("-", "")
        good = _iban(number.upper()) if cue == "iban" else sum(c in _DIGIT for c in number) >= 6
        return m.start(1), m.end(1), good
    return None


_PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "url": _url, "account": _account}


def find_spans(text: str | None) -> list[dict]:
    """The spans of one text, by kind as listed, then start; null and empty texts have none."""
    if not text:
        return []
    found: dict[str, list] = {k: [] for k in KINDS}
    past = dict.fromkeys(KINDS, 0)
    for end, (kind, back) in _automaton().iter(text.translate(_ASCII_LOWER)):
        at = end - back
        if at < past[kind]:
            continue
        hit = _PARSERS[kind](text, at, past[kind])
        if hit:
            start, stop, good = hit
            if start < past[kind]:
                continue
            past[kind] = stop
            if good:
                found[kind].append({"kind": kind, "start": start, "end": stop})
    return [x for k in KINDS for x in found[k]]


@F.arrow_udf(SPANS_TYPE)
def pii_spans(text: pa.Array) -> pa.Array:
    """Column function: the spans of each text, an empty list for null."""
    return pa.array([find_spans(x) for x in text.to_pylist()], pa.list_(SPAN))


def redact(text: str | None, spans: list[dict] | None) -> str | None:
    """The text with its spans replaced by their kind in angle brackets. Spans that overlap are one stretch, from the
    first start to the last end, named after the one that starts first (at a tie the longest)."""
    if text is None:
        return None
    out, reach = [], 0  # the text up to reach is told
    for x in sorted(spans or [], key=lambda x: (x["start"], -x["end"])):
        if x["start"] >= reach:
            out += [text[reach : x["start"]], f"<{x['kind'].upper()}>"]
        reach = max(reach, x["end"])
    return "".join(out) + text[reach:]


@F.arrow_udf(T.StringType())
def redacted(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Column function: each text without its personal data, null for null."""
    return pa.array([redact(t, s) for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True)], pa.string())


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the array column pii_spans. Every row stays, repeated rows too; a column pii_spans
    that docs has already is replaced."""
    return docs.withColumn("pii_spans", pii_spans(F.col(text)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans, and counts of the added kinds."""
    rows = find_pii(docs.select("doc_id", "text")).select("doc_id", "pii_spans")
    of = lambda k: F.size(F.filter("pii_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii_spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return rows.select("doc_id", *map(of, BASE_KINDS), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii_spans")).alias("spans"), *map(of, ADDED_KINDS))
