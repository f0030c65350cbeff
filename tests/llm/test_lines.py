"""Line deduplication against all pairs of plain shingle sets."""

import random

import pytest

from maskloom.llm import lines


def shingles(norm):
    return {norm[k : k + lines.SHINGLE] for k in range(max(len(norm) - lines.SHINGLE + 1, 1))}


def brute(rows):
    """Text of each row after keeping the first line of each component."""
    found = [(k, p, line.strip(" \t\n\x0b\f\r").lower()) for k, (_, t) in enumerate(rows) for p, line in enumerate((t or "").split("\n")) if line.strip(" \t\n\x0b\f\r")]
    norms = list(dict.fromkeys(x[2] for x in found))
    sets, parent = [shingles(n) for n in norms], list(range(len(norms)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = set()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 100 * len(a & b) >= 75 * len(a | b):
                links.add((norms[j], norms[i]))
                parent[root(i)] = root(j)
    comp = {n: root(k) for k, n in enumerate(norms)}
    first = {}
    for k, p, n in found:
        first[comp[n]] = min(first.get(comp[n], (rows[k][0], p)), (rows[k][0], p))
    gone = {(k, p) for k, p, n in found if first[comp[n]] != (rows[k][0], p)}
    return [None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (k, p) not in gone) for k, (_, t) in enumerate(rows)], links


def test_against_all_pairs(spark):
    rnd = random.Random(12)
    base = [" ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.choice([1, 2, 6, 20, 40]))) for _ in range(60)]

    def near(line):
        w = line.split()
        if len(w) > 10 and rnd.random() < 0.6:
            w[rnd.randrange(len(w))] = f"Z{rnd.randrange(999)}"
        return "  " * rnd.randint(0, 1) + " ".join(w).upper() if rnd.random() < 0.2 else " ".join(w)

    rows = [(k, "\n".join(near(rnd.choice(base)) if rnd.random() < 0.8 else "" for _ in range(rnd.randint(0, 9)))) for k in range(150)]
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, "x" * 100_000), (904, "x" * 100_000 + "\nnew line here"), (905, "日本語の長い文章がここにあります"), (906, "same\nsame\n same ")]
    want, links = brute(rows)
    docs = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, pos int, line string")
    got = {r.doc_id: r for r in lines.deduplicated(docs).collect()}
    assert lines.deduplicated(docs).columns == [*docs.columns, "n_lines", "n_removed"]
    assert [(i, got[i].text) for i, _ in rows] == [(i, want[k]) for k, (i, _) in enumerate(rows)]
    assert all(got[i].n_lines == len(t.split("\n")) for i, t in rows if t is not None)
    assert got[906].text == "same" and got[906].n_removed == 2 and got[904].text == "new line here" and got[900].text is None
    assert len(links) > 50
    assert lines.deduplicated(docs.limit(0)).count() == 0
    twice = lines.deduplicated(docs.filter("doc_id in (903, 904)").union(docs.filter("doc_id = 904"))).collect()
    assert sorted(r.text[:3] for r in twice) == ["new", "new", "xxx"]
    lone = spark.createDataFrame([(None, "one line\nb"), (None, "one line\nc"), (7, "one line")], "doc_id long, text string")
    assert sorted(r.text for r in lines.deduplicated(lone).collect()) == ["b", "c", "one line"]


def _bands(df, column):
    return lines.with_bands(df, column).withColumn(f"bands_{column}", lines.F.array_compact("bands")).drop("bands")


def test_recall_of_the_bands(spark):
    rnd = random.Random(3)
    pairs = []
    for _ in range(1500):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([12, 30, 60]))]
        other = words[:]
        for _ in range(max(1, len(words) // 24)):
            other[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
        pairs.append((" ".join(words), " ".join(other)))
    table = spark.createDataFrame(pairs, "a string, b string")
    one, other = (lines.shingle_hashes(lines.F.col(c)) for c in "ab")
    table = table.filter(100 * lines.F.size(lines.F.array_intersect(one, other)) >= 75 * lines.F.size(lines.F.array_union(one, other)))
    table = _bands(_bands(table, "a"), "b").cache()
    n, met = table.count(), table.filter(lines.F.arrays_overlap("bands_a", "bands_b")).count()
    assert n > 300 and met / n > 0.96, (met, n)


@pytest.mark.parametrize("words, length, edits", [(9, 60, 3), (9, 60, 4), (12, 40, 4), (12, 60, 5), (20, 40, 6)])
@pytest.mark.parametrize("place", ["begin", "end", "inside", "line end"])
def test_recall_wherever_the_edits_are(spark, words, length, edits, place):
    """Lines of long tokens, as paths and log fields, with a character changed at the begin or end of some tokens, inside
    of them, or all edits in the last token. The links of all pairs that are similar enough, found by their bands."""
    rnd, pairs = random.Random(f"{words}{length}{place}"), []
    token = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789/_") for _ in range(n))
    for _ in range(400):
        one = [token(length) for _ in range(words)]
        other = one[:]
        if place == "line end":
            other[-1] = other[-1][: -2 * edits] + token(2 * edits)
        else:
            for k in rnd.sample(range(words), edits):
                at = {"begin": 0, "end": length - 1, "inside": rnd.randrange(length)}[place]
                other[k] = other[k][:at] + "#" + other[k][at + 1 :]
        pairs.append((" ".join(one), " ".join(other)))
    pairs = [(a, b) for a, b in pairs if 100 * len(shingles(a) & shingles(b)) >= 75 * len(shingles(a) | shingles(b))]
    table = _bands(_bands(spark.createDataFrame(pairs, "a string, b string"), "a"), "b")
    met = table.filter(lines.F.arrays_overlap("bands_a", "bands_b")).count()
    assert len(pairs) > 100 and met / len(pairs) > 0.9, (met, len(pairs))


def test_edits_at_token_begins_end_to_end(spark):
    rnd, rows = random.Random(11), []
    for k in range(150):
        one = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(60)) for _ in range(9)]
        other = one[:]
        for j in rnd.sample(range(9), 4):
            other[j] = "#" + other[j][1:]
        assert 100 * len(shingles(" ".join(one)) & shingles(" ".join(other))) >= 75 * len(shingles(" ".join(one)) | shingles(" ".join(other)))
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(other))]
    removed = lines.report(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_removed > 0").count()
    assert removed > 0.93 * 150, removed


def test_a_crowded_band_misses_no_pair(spark):
    """Links that share a band of hundreds of lines, whose next minima differ; and the recall of all links there."""
    rnd = random.Random(5)
    words = lambda c, n: [f"{c}{rnd.randrange(10**6)}" for _ in range(n)]
    common, rows = words("w", 80), []
    for k in range(300):  # two lines of one pair are similar, those of two pairs are not
        own = words("v", 8)
        rows += [(2 * k + odd, " ".join(common + own + words("u", 12))) for odd in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = _bands(docs, "text").withColumn("hashes", lines.shingle_hashes(lines.F.col("text")))
    assert sets.select(lines.F.explode("bands_text").alias("band")).groupBy("band").count().filter("count > 300").count()
    side = lambda odd: sets.filter(f"doc_id % 2 = {odd}").select(lines.F.expr("doc_id div 2").alias("k"), lines.F.col("hashes").alias(f"h{odd}"), lines.F.col("bands_text").alias(f"b{odd}"))
    links = side(0).join(side(1), "k").filter("100 * size(array_intersect(h0, h1)) >= 75 * size(array_union(h0, h1))")
    every, shared = ({2 * r.k + 1 for r in x.select("k").collect()} for x in (links, links.filter("arrays_overlap(b0, b1)")))
    got = {r.doc_id for r in lines.duplicate_lines(docs).filter("NOT kept").collect()}
    assert len(shared) > 150 and shared <= got <= every, (len(shared), len(shared - got))
    assert len(got) / len(every) > 0.9


def test_sketches_are_never_further_apart_than_sets(spark):
    rnd = random.Random(2)
    rows = [(k, "".join(rnd.choice("ab c") for _ in range(rnd.choice([5, 30, 300])))) for k in range(60)]
    texts = spark.createDataFrame(rows, "line_id long, norm string")
    sketch = {r.line_id: r for r in lines._sketches(texts).collect()}
    sets = {k: shingles(t) for k, t in rows}
    assert all(sketch[k].size == len(s) for k, s in sets.items())
    for a, s in sets.items():
        for b, t in sets.items():
            words = [(sketch[a][f"w{k}"] ^ sketch[b][f"w{k}"]) & (1 << 64) - 1 for k in range(lines.WORDS)]
            assert sum(w.bit_count() for w in words) <= len(s ^ t)


def test_columns_of_the_same_names(spark):
    docs = spark.createDataFrame([(1, "one line here\nx", "k", [7]), (2, "one line here\ny", None, None)], "doc_id long, text string, row_key string, gone array<int>")
    got = sorted(tuple(r) for r in lines.deduplicated(docs).collect())
    assert got == [(1, "one line here\nx", "k", [7], 2, 0), (2, "y", None, None, 2, 1)]


def test_an_edit_in_a_run_without_white_space(spark):
    """One inserted or deleted character near the start moves no other shingle: similarities are those of full sets."""
    rnd = random.Random(8)
    runs = ["".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(120)), "https://example.org/" + "".join(rnd.choice("abcdefghij0123456789+/") for _ in range(180))]
    rows = [(10 * k + j, text) for k, run in enumerate(runs) for j, text in enumerate((run, run[:2] + "z" + run[2:], run[:3] + run[4:]))]
    for k, text in rows:
        assert 100 * len(shingles(text) & shingles(rows[k // 10 * 3][1])) >= 75 * len(shingles(text) | shingles(rows[k // 10 * 3][1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in lines.duplicate_lines(docs).filter("kept").collect()} == {0, 10}
    assert [r.n for r in docs.orderBy("doc_id").select(lines.F.size(lines.shingle_hashes(lines.F.col("text"))).alias("n")).collect()] == [len(shingles(t)) for _, t in rows]


def test_near_copies_of_one_line_are_not_told_as_all_pairs(spark, monkeypatch):
    """A crowd of edited copies that link with some of each other: the tables between steps grow with the lines."""
    rnd, base = random.Random(21), [f"w{k}x{k * k}" for k in range(60)]
    rows = [(k, " ".join(f"e{rnd.randrange(10**6)}" if rnd.random() < 0.045 else w for w in base)) for k in range(400)]
    counts, first = {}, lines.saved

    def saved(df, name):
        out = first(df, name)
        counts.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(lines, "saved", saved)
    got = lines.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).filter("kept").count()
    exact = sum(x == t for (_, t), x in zip(rows, brute(rows)[0], strict=True))
    assert exact <= got <= exact + 0.05 * len(rows), (exact, got)
    assert sum(counts["line-links"]) <= 3 * len(rows) and sum(counts["line-pairs"]) <= 15 * len(rows), counts


def test_a_pair_of_several_leaders_is_told_once(spark, monkeypatch):
    """Without an aggregation that would hide repeats, each candidate is told once."""
    rnd, base = random.Random(22), [f"w{k}x{k * k}" for k in range(60)]
    texts = spark.createDataFrame([(k, " ".join([*base[:-1], f"e{rnd.randrange(10**6)}"])) for k in range(1, 31)], "line_id long, norm string")
    monkeypatch.setattr(lines, "TILE", 7)
    stars = spark.createDataFrame([(lead, k) for lead in (1, 2, 3) for k in range(lead + 1, 31)], "lead long, line_id long")
    labels = spark.createDataFrame([(k, 1 if k < 5 else k) for k in range(1, 31)], "node long, component long")
    got = lines._across(lines._crowds(stars, lines._sketches(texts), labels), 75)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.a, r.b) for r in got.collect()) == [(a, b) for a in range(1, 31) for b in range(max(a + 1, 5), 31)]


def test_signatures_tell_all_shingles_without_an_array_of_them(spark):
    """Hashes up to a bound give the signature of all hashes, also for lines that repeat themselves and for characters
    beyond 16 bits; no line's shingles are put into an array."""
    rnd = random.Random(31)
    texts = ["".join(rnd.choice("abcdefgh é日😀") for _ in range(n)) for n in (1, 5, 11, 12, 13, 24, 36, 90, 400, 3000) for _ in range(5)]
    texts += ["ab" * 2000, "abc " * 50 + "one more end", "-" * 5000, "0123456789" * 300 + "x"]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "line_id long, norm string")
    every = {r.line_id: r.minima for r in lines._minima(lines._hashed(table)).collect()}
    hashes = {}
    for r in lines._hashed(table).collect():
        hashes.setdefault(r.line_id, set()).add(r.h)
    for k, text in enumerate(texts):
        assert len(hashes[k]) == len(shingles(text)), text
        least = {}
        for h in hashes[k]:
            least[h % lines.BINS] = min(h, least.get(h % lines.BINS, h))
        assert every[k] == sorted(least.values())
    few = {r.line_id for r in lines._minima(lines._hashed(table, lines.KEPT)).filter(f"bound IS NOT NULL AND size(minima) < {lines.MINIMA}").collect()}
    assert {len(texts) - 4, len(texts) - 2} <= few
    got = {r.line_id: r.bands for r in lines.signatures(table).collect()}
    assert sorted(got) == list(range(len(texts)))
    ends = spark.createDataFrame([(k, x, y) for k, m in every.items() for x, y in zip(m[: lines.BANDS], m[1 : lines.MINIMA] or [0])], "k long, x long, y long")
    want = {}
    for r in ends.select("k", lines.F.xxhash64("x", "y").alias("band")).collect():
        want.setdefault(r.k, set()).add(r.band)
    assert {k: {b for b in bands if b is not None} for k, bands in got.items()} == want
    plan = lines.with_bands(table)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "lambda" not in plan
