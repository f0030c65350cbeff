"""Signatures and the whole join against all pairs of plain shingle sets."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from maskloom.llm import ngrams


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(((k, len(s), least.get(root(i))) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def edited(words, n, rnd):
    words = words[:]
    for _ in range(n):
        k = rnd.randrange(len(words))
        words[k : k + rnd.choice([0, 1, 1, 1])] = [f"x{rnd.randrange(10**6)}"] * rnd.choice([1, 1, 1, 2])
    return words


def test_shingle_sets_and_signatures():
    rnd = random.Random(6)
    texts = [None, "", " \t\x0b", "One", "a b", "A b C d", "a b c d e", "a b c d e f a b c d e", "é É x y z", "b\x1cc d e f g\xa0h"]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) for _ in range(100)]
    assert [len(s) for s in ngrams.shingle_sets(texts)] == [len(shingles(t)) for t in texts]
    misses = pairs = 0
    for _ in range(400):
        n = rnd.choice([6, 12, 30, 80, 300, 1500])
        words = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        other = edited(words, max(1, rnd.randrange(max(2, n // 14))), rnd)
        if rnd.random() < 0.3:
            other = other[: int(n * rnd.uniform(0.72, 1))]
        a, b = ngrams.shingle_sets([" ".join(words), " ".join(other)])
        if linked(set(a.tolist()), set(b.tolist())):
            pairs += 1
            misses += not set(ngrams.signatures(a).tolist()) & set(ngrams.signatures(b).tolist())
            assert ngrams._fits_of(np.array([len(a)]), [ngrams.sketch(a)], np.array([len(b)]), [ngrams.sketch(b)])[0].all()
    assert pairs > 100 and not misses


def test_bands_cover_all_sizes():
    for n in [*range(1, 400), 1000, 12345]:
        bands = {b for b, _, _ in ngrams.instances(n)}
        for m in (n, n * 4 // 3):
            if 100 * n >= 75 * m:
                assert bands & {b for b, _, _ in ngrams.instances(m)} and int(np.searchsorted(ngrams._TOP, m)) in bands
        for _, parts, signed in ngrams.instances(n):
            assert parts >= signed


def test_query(spark, monkeypatch):
    rnd = random.Random(8)
    rows = []
    passage = " ".join(f"p{k}" for k in range(60))
    for k in range(40):
        words = [f"v{rnd.randrange(3000)}" for _ in range(rnd.choice([3, 5, 8, 40, 120, 400]))]
        rows.append((1000 - k, " ".join(words)))
        for _ in range(rnd.choice([0, 0, 1, 4, 12])):
            rows.append((2000 + len(rows), " ".join(edited(words, rnd.choice([0, 1, 2, len(words) // 20 + 1]), rnd))))
    rows += [(5000 + k, " ".join(f"q{rnd.randrange(10**6)}" for _ in range(90)) + " " + passage) for k in range(30)]
    chain = [f"c{k}" for k in range(100)]
    for k in range(25):
        chain = edited(chain, 2, rnd)
        rows.append((6000 + k, " ".join(chain)))
    rows += [(1, None), (2, ""), (3, "  "), (4, "a b"), (5, "A  B"), (5, "A  B"), (None, "a b"), (7, "z " * 30_000), (None, "only here")]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, cls int, bucket string")
    want = brute(rows)
    assert sorted(map(tuple, ngrams.near_duplicates(docs).collect()), key=str) == want
    monkeypatch.setattr(ngrams, "TILE", 2)
    monkeypatch.setattr(ngrams, "PARTNERS", 2)
    assert sorted(map(tuple, ngrams.near_duplicates(docs).collect()), key=str) == want
    kept = ngrams.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(k) for k, _, c in want if k is None or k == c)
    assert ngrams.near_duplicates(docs.limit(0)).count() == 0


def test_copies_are_not_shuffled(spark):
    """Of the copies in a block one is signed, and every copy gets its row."""
    words = [f"w{k}" for k in range(60)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(k, text if k % 2 else text.upper()) for k in range(1000)] + [(None, text), (2000, near), (2001, "quite another text of some words"), (2002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = docs.coalesce(1).select("text").mapInArrow(ngrams._pack(12), ngrams._PACKED)
    signed = sum(len(r.signatures) // 4 for r in packed.collect())
    assert signed == sum(len(ngrams.signatures(s)) for s in ngrams.shingle_sets([text, near, rows[-2][1]]))
    got = ngrams.near_duplicates(docs).collect()
    want = sorted([(k, 0) for k in range(1000)] + [(2000, 0), (2001, 2001), (2002, 2002)]) + [(None, 0)]
    assert sorted(((r.doc_id, r.component_id) for r in got), key=lambda x: (x[0] is None, x)) == want


def test_near_copies_of_one_text_are_not_told_as_all_pairs(spark, monkeypatch):
    """A crowd of edited copies that link with some of each other: candidates across components grow with the texts."""
    rnd, base = random.Random(21), [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(edited(base, 4, rnd))) for k in range(400)]
    counts, first = [], ngrams._open_pairs

    def pairs(*args):
        out = first(*args)
        counts.append(out.count())
        return out

    monkeypatch.setattr(ngrams, "_open_pairs", pairs)
    got = ngrams.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert sum(counts) <= 6 * len(rows), counts


def test_a_pair_of_several_leaders_is_told_once(spark, monkeypatch):
    """Two near copies share most signatures, so many leaders: without an aggregation each candidate is told once."""
    rnd, base = random.Random(22), [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(edited(base, 4, rnd))) for k in range(300)]
    counts, first = [], ngrams._open_pairs

    def pairs(crowds):
        out = first(crowds)
        told = crowds.join(crowds.select("leader", F.col("cls").alias("other")), "leader").filter("cls < other").select("cls", "other")
        counts.append((out.count(), out.distinct().count(), told.count() > 3 * told.distinct().count(), "Aggregate" in out._jdf.queryExecution().optimizedPlan().toString()))
        return out

    monkeypatch.setattr(ngrams, "_open_pairs", pairs)
    monkeypatch.setattr(ngrams, "TILE", 40)
    got = ngrams.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert counts and all(n == different > 0 and many and not grouped for n, different, many, grouped in counts), counts
