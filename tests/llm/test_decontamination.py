"""Decontamination against a plain search, its SQL, and its edges."""

import hashlib
import random
import re

import duckdb
import pytest

from maskloom.llm import decontamination, queries

SF = "/root/testdata/sf0.001"
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def plain(docs, items):
    out = []
    for doc, text in docs:
        w, hit, listed = words(text), set(), set()
        for item, other in items:
            v = words(other)
            n = min(len(v), 10)
            for win in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else ():
                for p in range(len(w) - n + 1):
                    if tuple(w[p : p + n]) == win:
                        hit |= set(range(p, p + n))
                        listed |= {str(item)} if item is not None else set()
        out.append((doc, len(w), len(hit), len(listed), hashlib.sha256(",".join(sorted(listed)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def random_tables(seed, n_docs=120):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "ÉTÉ", "9", "日本", "x"]
    sentence = lambda a, b: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", ", ", "\n", "--", "\x7f"]) for _ in range(rng.randint(a, b)))
    items = [(rng.choice([k, k, None]), sentence(0, 25)) for k in range(20)] + [(3, "alpha"), (4, None), (5, "日本 x"), (6, "?!")]
    docs = []
    for k in range(n_docs):
        text = sentence(0, 40)
        for _ in range(rng.randint(0, 2)):
            other = (rng.choice(items)[1] or "").split(" ")
            text += rng.choice([" ", "..."]) + rng.choice([str.upper, str.lower, str])(" ".join(other[rng.randint(0, 3) :])) + " " + sentence(0, 5)
        docs.append((rng.choice([k, k, None]), rng.choice([text] * 9 + [None])))
    return docs + docs[:5], items


def test_against_plain_search(spark):
    docs, items = random_tables(1)
    got = decontamination.digest(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items)


@pytest.mark.parametrize("block", [1, 400, 2000])
def test_blocks_find_the_same(spark, block):
    docs, items = random_tables(2, 60)
    rows = decontamination.scanned(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items[:8], ITEMS), block=block)
    whole = decontamination.scanned(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items[:8], ITEMS))
    assert sorted(rows.collect(), key=str) == sorted(whole.collect(), key=str)


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.op13_decontamination(spark, SF), con.sql(decontamination.ORACLE_SQL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_spans_are_those_of_the_text(spark, monkeypatch):
    """Spans in code points hold just the words of their ranges, also where a text is read in many slices."""
    docs, items = random_tables(3)
    for size in (1 << 20, 16):
        monkeypatch.setattr(decontamination, "SLICE", size)
        automaton = decontamination.Automaton([(str(k), words(t)) for k, t in items if words(t)])
        for _, text in docs:
            raw = (text or "").encode()
            folded = raw.translate(decontamination._FOLDED)
            n, ranges, _ = automaton.scan(folded)
            assert n == len(words(text))
            for (a, b), (start, end) in zip(ranges, decontamination._spans(raw, folded, ranges) if ranges else [], strict=True):
                assert words(text[start:end]) == words(text)[a : b + 1]
                assert words(text[:start]) == words(text)[:a] and text[start:end] == text[start:end].strip(" ,\n-\x7f")


def test_long_items_keep_all_windows(spark):
    rng = random.Random(4)
    item = [f"w{rng.randint(0, 10**9)}" for _ in range(3500)]
    docs = [(k, " ".join(item[k : k + 10])) for k in range(0, 3491, 10)] + [(-k, " ".join(item[k : k + 9])) for k in range(1, 50)]
    got = decontamination.digest(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, " ".join(item))], ITEMS)).collect()
    assert all(r.contaminated == (r.doc_id >= 0) and r.n_hit == (10 if r.doc_id >= 0 else 0) for r in got)


def test_edges(spark):
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "...")] + [(4, "one two three. " * 100_000)], DOCS).selectExpr("*", "1 AS contamination", "2 AS item_id", "3 AS found")
    items = spark.createDataFrame([(1, "Two, three"), (1, "three ONE two"), (2, "")], ITEMS).selectExpr("*", "5 AS doc_id", "6 AS block", "7 AS item")
    assert decontamination.digest(no_docs, items).collect() == []
    assert not any(r.contaminated for r in decontamination.digest(docs, no_items).collect())
    got = {r.doc_id: r for r in decontamination.digest(docs, items).collect()}
    assert [got[k].n_words for k in (1, 2, 3, 4)] == [0, 0, 0, 300_000]
    assert got[4].n_hit == 299_999 and got[4].n_items == 1
    assert set(decontamination.scanned(docs, items).columns) == {"doc_id", "text", "contamination", "item_id", "found"}


def test_passages_go(spark):
    docs = spark.createDataFrame([(1, "Keep this. One two  three! And this."), (2, "clean"), (3, None)], DOCS)
    items = spark.createDataFrame([(1, "one two three")], ITEMS)
    got = {r.doc_id: r.text for r in decontamination.without_passages(docs, items).collect()}
    assert got == {1: "Keep this. ! And this.", 2: "clean", 3: None}
