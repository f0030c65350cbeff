"""The term automaton against the alternation of all terms, and large dictionaries."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from maskloom.functions.automaton import Spelling, TermFinder
from maskloom.functions.regexlang import term_pattern
from maskloom.operators import guard, masking
from maskloom.sources import dictionary as D

PARTS = ["a", "K", "k", "K", "ſ", "s", "S", "ß", "ẞ", "SS", "ς", "Σ", "σ", "µ", "μ", "İ", "ı", "i", "I", "알파", "漢", "-", "_", "9", ".", " ", "  ", "\n", " ", "　 ", "é", "É", "😀"]


def alternation(spellings, text):
    """Leftmost hits of all patterns in one expression."""
    pattern = re.compile("|".join(f"(?P<t{k}>{term_pattern(s.term, s.strict, s.any_case)})" for k, s in enumerate(spellings)), re.ASCII)
    return [(m.start(), m.end(), int(m.lastgroup[1:])) for m in pattern.finditer(text)]


@pytest.mark.parametrize("seed", range(6))
def test_equal_to_the_alternation(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choices(PARTS, k=rng.randint(1, n)))
    for _ in range(400):
        spellings = [Spelling(t, rng.random() < 0.3, rng.random() < 0.8) for t in (word(4) for _ in range(rng.randint(1, 6))) if t.strip(" 　 \n")]
        spellings.sort(key=lambda s: -len(s.term))
        text = "".join(rng.choice([word(3), rng.choice(spellings).term if spellings else "", rng.choice(spellings).term.upper() if spellings else ""]) for _ in range(8))
        finder = TermFinder(spellings)
        want = alternation(spellings, text) if spellings else []
        assert finder.leftmost(text) == want, (spellings, text)
        assert finder.present(text) == {k for k, s in enumerate(spellings) if re.search(term_pattern(s.term, s.strict, s.any_case), text, re.ASCII)}


def test_entity_of_the_spelling_that_matches():
    """Of two terms that differ in case and strictness only, the one whose edges fit."""
    d = D.Dictionary(terms=[D.Term(0, "A", "알파", "알파", True, False, "1A"), D.Term(1, "B", "알파", "알파", False, False, "1A")])
    assert [x[2] for x in masking.Finder(d)("글알파 알파")] == ["B", "A"]


@pytest.mark.parametrize("pattern, needed", [(r"[a-z]+@[a-z]+\.de", "@"), (r"[0-9]{40}", ""), (r"(?:x|y)z", "z"), (r"a?b", "b"), ("", "")])
def test_needed_character(pattern, needed):
    assert masking.needed_character(pattern) == needed


def _numbered(n):
    return D.parse_dictionary("CODE:\n" + "".join(f"  - Code {k:05d}x\n" for k in range(n)))


def test_twenty_thousand_terms(spark):
    large, small = _numbered(20_000), _numbered(20)
    texts = [f"code  {k:05d}X, Code {k % 20:05d}x and code {k}y" for k in range(0, 20_000, 7)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    got = masking.spans_relation(masking.find_spans(rows, "text", large)).groupBy("entity").count().collect()
    assert [r["count"] for r in got] == [2 * len(texts)]
    find, few, took = masking.Finder(large), masking.Finder(small), {}
    assert [x[3] for x in find(texts[5])] == ["code  00035X", "Code 00015x"]
    for name, f in (("large", find), ("small", few)):
        f("x")
        began = time.perf_counter()
        for t in texts:
            f("no term of the list is in this long enough text " * 20 + t)
        took[name] = time.perf_counter() - began
    assert took["large"] < 3 * took["small"]


def test_five_thousand_guard_rules(spark):
    d = _numbered(5000)
    d.terms += [D.Term(9000, "EXACT", "Éa", "Éa", False, False, "1A"), D.Term(9001, "EXACT", "b", "b", False, False, "1A")]
    d.patterns.append((0, "NUMBER", "[0-9]{7}"))
    texts = ["code 00001x CODE\n00002X code 00001x", "éa Éa B", "éa 1234567", "nothing", None, ""]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r for r in rows.select("k", guard.leaks(F.col("t"), d).alias("n"), guard.leak(F.col("t"), d).alias("any")).collect()}
    assert [got[k].n for k in range(6)] == [{"CODE": 2}, {"EXACT": 2}, {"NUMBER": 1}, {}, {}, {}]
    assert [got[k].any for k in range(6)] == [True, True, True, False, False, False]
    plan = lambda n: len(rows.select(guard.leaks(F.col("t"), _numbered(n)))._jdf.queryExecution().toString())
    assert plan(5000) == plan(5)


def test_long_text_in_linear_time(spark):
    """A million hits between runs of white space."""
    d = D.parse_dictionary("A: [new york, york]")
    text = "New \n York, york  x" * 300_000
    began = time.perf_counter()
    spans = masking.Finder(d)(text)
    assert len(spans) == 600_000 and time.perf_counter() - began < 60
    assert spans[0] == (0, 10, "A", "New \n York", "1A") and text[spans[-1][0] : spans[-1][1]] == spans[-1][3]
