"""Phrases against a plain count, their SQL, and their edges."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from maskloom.llm import phrases, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"


def plain(rows, least=phrases.LEAST, top=phrases.TOP):
    out = []
    for lang in {r[2] if r[2] is not None else "und" for r in rows}:
        f = Counter()
        for _, text, of in rows:
            if (of if of is not None else "und") == lang:
                lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
                    words = re.findall(r"[^\x20\x09]+", piece)
                    f.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        known = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        found = []
        for p, a in known.items():
            if not any(len(q) > len(p) and 100 * b >= 80 * a and inside(p, q) for q, b in known.items()):
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def random_rows(n, seed):
    rng = random.Random(seed)
    words = ["new", "York", "city", "of", "the", "É", "ab", "\x00x", "\x1cy", "日本", "a b"]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ".\n", " :", "\r\n", "\x0b"]
    return [(k, None if rng.random() < 0.05 else "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "fr", None])) for k in range(n)]


def test_against_plain_count(spark):
    rows = random_rows(300, 5)
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, got.collect())) == plain(rows)
    assert sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, SCHEMA), top=7, least=4).collect())) == plain(rows, 4, 7)


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = queries.op12_phrase_mining(spark, SF), con.sql(phrases.ORACLE_SQL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_chunks_have_each_phrase_once(monkeypatch, k):
    """Whatever the size of a chunk, also where words are longer than it."""
    rng = random.Random(k)
    for size in (4, 9, 30, 1000):
        monkeypatch.setattr(phrases, "CHUNK", size)
        for _ in range(30):
            text = "".join(rng.choice(["a", "bc", "d" * 25, " ", " ", " ", "\n", "e "]) for _ in range(rng.randint(0, 60))).encode()
            want = Counter(" ".join(w[i : i + k]).encode() for w in (p.decode().split() for p in text.split(b"\n")) for i in range(len(w) - k + 1))
            every = np.full(1024, 255, np.uint8)
            got = Counter(p for some in phrases._phrases(text, k, "en", every, phrases.Hashes()) for p in some)
            assert got == want


def test_full_bitmap_changes_no_count(spark, monkeypatch):
    """A bitmap that is much too small lets phrases through; counts stay exact."""
    rows = random_rows(200, 6)
    monkeypatch.setattr(phrases, "_bitmap", lambda frequent: np.full(8, 0xFF, np.uint8))
    assert sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, SCHEMA), least=5).collect())) == plain(rows, 5)


def test_tables_too_large_for_a_broadcast(spark, monkeypatch):
    rows = random_rows(200, 7)
    monkeypatch.setattr(phrases, "broadcast_if_few", lambda df, counted=None: df)
    assert sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, SCHEMA)).collect())) == plain(rows)


def test_small_holdings_are_added_up(spark, monkeypatch):
    rows = random_rows(120, 9)
    monkeypatch.setattr(phrases, "HELD", 3)
    df = spark.createDataFrame(rows, SCHEMA)
    counter = phrases._counter(1, None)
    got = Counter()
    for batch in counter(df.selectExpr("coalesce(lang, 'und') AS lang", "text").filter("text <> ''").toArrow().to_batches()):
        for lang, phrase, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got[lang, phrase] += f
    assert sum(v for (_, p), v in got.items() if p is None) == sum(v for (_, p), v in got.items() if p is not None)


def test_exact_products(spark):
    """Counts whose product passes 64 bits."""
    a = 9_000_000_000_000_000_000
    counts = spark.createDataFrame([("en", "x", a), ("en", "y", a + 5)], "lang string, phrase string, f long")
    row = phrases.scored(spark.createDataFrame([("en", "x y", a)], "lang string, phrase string, f long"), counts).first()
    assert row.score == 2_000_000 * a // (a + a + 5) and (row.l, row.r) == (a, a + 5)


def test_edges(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, "en"), (2, "", None), (3, " ., \n", "en")], SCHEMA)).collect() == []
    long = "to be or not to be " * 200_000
    rows = spark.createDataFrame([(1, long, None), (1, long, None)], SCHEMA).selectExpr("*", "1 AS phrase", "2 AS f", "3 AS n")
    got = {r.phrase: r for r in phrases.collocations(rows).collect()}
    assert got["be or not to"].a == 400_000 and {r.lang for r in got.values()} == {"und"} and {r.n for r in got.values()} == {2_400_000}
