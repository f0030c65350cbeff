"""Anchors against plain regular expressions over random and planted texts."""

import random
import re

from maskloom.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def holds(kind, s):
    digits = re.sub("[^0-9]", "", s)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda: 16 <= len(digits) <= 19 and pii.luhn(digits),
        "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def plain(text):
    return [(k, m.start(), m.end()) for k, r in PLAIN.items() for m in r.finditer(text) if holds(k, m[0])]


def base(text):
    return [(x["kind"], x["start"], x["end"]) for x in pii.find_spans(text) if x["kind"] in pii.BASE_KINDS]


def test_against_regular_expressions():
    rnd = random.Random(5)
    parts = ["a", "B.", "@", "@x.y", "1", "12", "255", "256", ".", "-", " ", "+", "+1", "(", ")", "é", "😀", "4111 1111 1111 1111", "4785380592391139", "+1 (743) 555-3824", "1.2.3.4", "user@example.com", "://", "http", "account", "0"]
    for _ in range(6000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        assert base(text) == plain(text), text


def test_added_kinds():
    found = [(x["kind"], "see https://a.example/x?y=1, IBAN DE89 3704 0044 0532 0130 00 and account no 12345678."[x["start"] : x["end"]]) for x in pii.find_spans("see https://a.example/x?y=1, IBAN DE89 3704 0044 0532 0130 00 and account no 12345678.")]
    assert ("url", "https://a.example/x?y=1") in found and ("account", "DE89 3704 0044 0532 0130 00") in found and ("account", "12345678") in found


def test_query_edges(spark):
    rows = [(1, None), (2, ""), (3, "😀 a@b.co 1.2.3.4"), (3, "😀 a@b.co 1.2.3.4"), (None, "x" * 200_000 + " +1 (743) 555-3824"), (5, "1." * 50_000)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n_email string")
    got = pii.digest(docs).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_phone) for r in got) == [(0, 0, 0, 1), (1, 0, 0, 0), (2, 0, 0, 0), (3, 1, 1, 0), (3, 1, 1, 0), (5, 0, 12500, 0)]
    assert [r.spans for r in got if r.doc_id == 3] == ["email:2:8,ip:9:16"] * 2
    assert pii.digest(docs.limit(0)).count() == 0
    out = pii.find_pii(docs).select(pii.redacted(pii.F.col("text"), pii.F.col("pii_spans")).alias("t")).collect()
    assert "😀 <EMAIL> <IP>" in {r.t for r in out}


def test_account_cues_in_any_case():
    for text in ("Account Number: 12345678", "Account No: 12345678", "Customer ID: 12345678", "User ID 12345678", "aCCount number 12345678", "account NUMBER 12345678"):
        assert [text[x["start"] : x["end"]] for x in pii.find_spans(text) if x["kind"] == "account"] == ["12345678"], text
    text = "IBAN NO9386011117947"  # a country, not the word
    assert [text[x["start"] : x["end"]] for x in pii.find_spans(text) if x["kind"] == "account"] == ["NO9386011117947"]


def test_redaction_of_overlapping_spans(spark):
    """Spans that overlap are one stretch; nothing of the later one stays."""
    text = "host 10.0.0.4 111 1111 1111 1111 end"
    spans = pii.find_spans(text)
    assert {x["kind"] for x in spans} >= {"ip", "card"}
    assert pii.redact(text, spans) == "host <IP> end"
    assert pii.redact(None, None) is None and pii.redact("", []) == ""
    rows = spark.createDataFrame([(text,), (None,), ("a@b.co",)], "text string")
    got = [r.t for r in pii.find_pii(rows).select(pii.redacted("text", "pii_spans").alias("t")).collect()]
    assert got == ["host <IP> end", None, "<EMAIL>"]
