"""Derivatives against a parser of the standard library, serialised records, edges."""

import base64
import hashlib
import random
import time
from html.parser import HTMLParser

from maskloom.llm import warc


class Reader(HTMLParser):
    """Visible words and link targets."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.links, self.hidden = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")
        self.links += [v for k, v in attrs if tag == "a" and k == "href"]

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head")

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = warc.derivatives(pages).collect()
    given = {r.page_id: r for r in pages.collect()}
    sources = {r.page_id: r for r in warc.responses(pages).drop("block").collect()}
    assert len(rows) == 2 * len(given) and len({r.record_id for r in rows}) == len(rows)
    for r in rows:
        page, source = given[r.page_id], sources[r.page_id]
        reader = Reader()
        reader.feed(page.html)
        assert (r.refers_to, r.target_uri, r.source_payload_digest) == (source.record_id, page.url, source.payload_digest)
        assert r.source_payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(page.html.encode()).digest()).decode() and r.source_digest_ok
        assert r.content_length == len(r.block.encode()) and r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(r.block.encode()).digest()).decode()
        if r.warc_type == "conversion":
            assert "".join(r.block.split()) == "".join(reader.words), r.page_id
        else:
            links = [line.split()[1] for line in r.block.split("\r\n") if line.startswith("outlink: ") and line.endswith(" a")]
            assert links == list(dict.fromkeys(reader.links)) and "http-header-content-type: text/html; charset=utf-8" in r.block


def test_other_responses():
    image = warc.derive_one("<r>", None, "d", b"HTTP/1.1 404 Not Found\r\nContent-Type: image/png\r\nX-A: 1\r\n 2\r\n\r\n\x89PNG", "sha1:WRONG")
    assert [r["warc_type"] for r in image] == ["metadata"] and b"http-header-x-a: 1 2" in image[0]["block"] and b"http-status: 404" in image[0]["block"]
    assert not image[0]["source_digest_ok"] and image[0]["source_payload_digest"] == "sha1:WRONG"
    latin = warc.derive_one("<r>", "u", "d", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n<p>caf\xe9<!-- <a href='/no'> --><br>x &lt; y", None)
    assert latin[1]["block"].decode() == "café\nx < y" and b"outlink" not in latin[0]["block"]
    raw = warc.serialized(latin[1])
    head, _, body = raw.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: conversion") and b"WARC-Refers-To: <r>" in head and body == latin[1]["block"] + b"\r\n\r\n"
    assert warc.derive_one("<r>", None, None, None, None)[0]["content_length"] > 0


def test_edges(spark):
    pages = spark.createDataFrame([(1, None, None, 0), (None, "u", "", 0), (3, "u", "<p>" + "x" * 300_000, 0), (3, "u", "<p>" + "x" * 300_000, 0), (4, "u", "<" * 50_000, 0)], "page_id long, url string, html string, record_id int")
    rows = warc.derivatives(pages).collect()
    assert sorted((r.page_id or 0, r.warc_type) for r in rows if r.page_id == 3) == [(3, "conversion")] * 2 + [(3, "metadata")] * 2
    assert len(rows) == 10 and warc.derivatives(pages.limit(0)).count() == 0
    assert warc.with_bytes(warc.derive(warc.responses(pages))).filter("warc is null").count() == 0
    assert warc.derive(warc.responses(pages).withColumn("warc_type", warc.F.lit("request"))).count() == 0


def test_unclosed_markup_takes_linear_time():
    """Megabytes of what is never closed."""
    began = time.time()
    for piece in ("<a ", "<script ", "<title>", "<!--", "<script>x", "</script ", "<a href='", "<p>x", "<", "<style><a href=x>"):
        markup = piece * (1_000_000 // len(piece))
        warc.plain_text(markup), warc.outlinks(markup), warc.title_of(markup)
    assert time.time() - began < 20


def test_markup_by_the_piece():
    page = "<head><title> A &amp;\nB</title><link href=/c></head><p>one<br>two < three<!-- no <p> --><script>if (a<b) x</script >four <b>five</b>\nsix<template>y"
    assert warc.plain_text(page) == "one\ntwo < three four five six" and warc.title_of(page) == "A & B"
    assert warc.outlinks(page + "</template><IMG alt='' SRC = \"q?a=1&amp;b=2\"><!-- <a href=/n> --><a href='/m'><a href='/m'>") == [("link", "/c"), ("img", "q?a=1&b=2"), ("a", "/m")]
    assert warc.title_of("<title>x") is None and warc.plain_text("<style>a{}") == ""


def test_quotes_in_tags():
    assert warc.outlinks('<a title="a>b" href="/x">t</a>') == [("a", "/x")] and warc.plain_text('<a title="a>b" href="/x">t</a>') == "t"
    assert warc.outlinks('<a title="x href=/no" href="/yes">') == [("a", "/yes")]
    assert warc.outlinks("<a href = '/a\"b' HREF=/no><img/src=/i.png/><a data-href=/no><a href=/b?x=1>") == [("a", '/a"b'), ("img", "/i.png/"), ("a", "/b?x=1")]
    # an open quote: what is behind it belongs to the tag
    assert warc.plain_text('<p>seen<a title="open>gone<p>gone') == "seen" and warc.outlinks('<a href="/x>y') == []
    assert warc.plain_text("a < b, it's <b>5 > 4</b>") == "a < b, it's 5 > 4"


def test_random_markup_against_the_standard_library():
    rng = random.Random(1)
    values = ['"a>b"', "'x>\"y'", '"it\'s"', "bare", "/p?q=1&amp;r=2", '""', "'</a>'", '"<b>"']
    for _ in range(2000):
        parts = []
        for _ in range(rng.randint(1, 8)):
            names = rng.sample(["href", "title", "data-href", "alt", "HREF"], rng.randint(0, 3))
            if sum(n.lower() == "href" for n in names) > 1:
                names.remove("HREF")  # of two the first one counts here, as in browsers
            attributes = "".join(f"{rng.choice([' ', chr(10), '  '])}{n}{rng.choice(['=', ' = ', '= '])}{rng.choice(values)}" for n in names)
            parts.append(rng.choice([f"<a{attributes}>", f"<div{attributes} >", "</a>", "</div>", "word ", "x &lt; y ", "<!-- <a href='/no'> -->"]))
        markup = "".join(parts)
        reader = Reader()
        reader.feed(markup)
        reader.close()
        assert "".join(warc.plain_text(markup).split()) == "".join(reader.words), markup
        assert [t for _, t in warc.outlinks(markup)] == list(dict.fromkeys(v.strip() for v in reader.links if v)), markup


def test_markup_of_quotes_in_linear_time():
    for markup in ('<a title="x' * 200_000, "<a b='c" * 200_000, '<a x="' + "<a y='>" * 200_000, "<a " + "b " * 400_000, '<a href="/x">' * 100_000):
        began = time.perf_counter()
        warc.plain_text(markup)
        warc.outlinks(markup)
        assert time.perf_counter() - began < 10
