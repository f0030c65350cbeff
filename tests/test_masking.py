"""Parity vectors, spans, tokens, restoring and the leak check."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from maskloom.functions.regexlang import translated
from maskloom.operators import guard, masking
from maskloom.plans import fixtures
from maskloom.sources import dictionary as D

PARITY = D.parse_dictionary(fixtures.PARITY_YAML)


@pytest.mark.parametrize("escape", [False, True])
def test_parity_vectors(spark, escape):
    df = spark.createDataFrame([(v[0], v[1]) for v in fixtures.PARITY_VECTORS], "name string, text string")
    rows = masking.restore(masking.mask(df, "text", PARITY, escape=escape), "masked", "entries")
    got = {r.name: r for r in guard.guarded(rows, "masked", PARITY).collect()}
    for name, text, masked, restored in fixtures.PARITY_VECTORS:
        assert (got[name].masked, got[name].restored_text, got[name].leak) == (masked, restored if restored is not None else text, False), name


def test_traps(spark):
    texts = ["연락처010-1234-5678입니다", "메일 user@example.com으로", "corp CORP Corp", "K orp ſ", "Project 오로라 Project  오로라", "\\CORP and CORP", "a​CO​RP", None, "", "<X_1A> <<X_1A>> <<X_1A> <X_1A>>"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: r for r in masking.mask(df, "text", PARITY, escape=True).collect()}
    assert got[0].masked == "연락처<PHONE_1A>입니다" and got[1].masked == "메일 <EMAIL_1A>으로"
    assert got[2].masked == "<CUSTOMER_1A> <CUSTOMER_1A> <CUSTOMER_1A>" and got[2].hits == {"CUSTOMER": 3} and got[2].max_group == {"CUSTOMER": 1}
    assert got[4].masked == "<PROJECT_1A> <PROJECT_2A>" and got[4].max_group == {"PROJECT": 2}
    assert got[5].masked == "CORP and <CUSTOMER_1A>" and got[5].bypassed == {"CUSTOMER": 1}
    assert got[6].masked == "a" + "CORP" and got[7].masked is None and got[8].masked == ""
    assert got[9].masked == "<<X_1A>> <<X_1A>> <<<X_1A>> <<X_1A>>>"


def test_dictionary_rules():
    for bad in ("a: [x y]", "A: [b]", "A: ['  ']", "A:\n  patterns: ['(a+)+$']", "A:\n  patterns: ['" + "a" * 201 + "']", "A: [xy]\nB: [xy]", "A:\n  patterns: ['(?i)x']", "A:\n  patterns: ['[']"):
        with pytest.raises(D.DictionaryError):
            D.parse_dictionary(bad)
    d = D.parse_dictionary("COMPANY:\n - '한국전력공사, 한전, 한국전력'\nPROJECT:\n - Project 오로라\n - {term: 가, allow_short: true, boundary: strict}")
    assert [(t.term, t.suffix) for t in d.terms] == [("한국전력공사", "1A"), ("한전", "1B"), ("한국전력", "1C"), ("Project 오로라", "1A"), ("가", "2A")]
    assert D.letter_index(25) == "Z" and D.letter_index(26) == "AA"


def test_translation():
    import re

    p = re.compile(translated(r"\b01[016-9][-\s]?\d{4}$", java=False), re.ASCII)
    assert p.search("가010 1234") and not p.search("x010-1234") and not p.search("010-1234\n")


def test_overlap_and_mapping(spark):
    d = D.parse_dictionary("A: [new york, york city]\nN:\n  patterns: ['[0-9]+', 'york [0-9]+']")
    df = spark.createDataFrame([(1, "New  York city 12, york 55")], "k int, text string")
    row = masking.mask(df, "text", d).select("masked", "entries", masking.mapping_json(masking.F.col("entries"), masking.F.col("max_group")).alias("j")).first()
    assert row.masked == "<A_1A> city <N_1A>, <N_2A>"
    back = spark.createDataFrame([(row.j,)], "j string").select(masking.mapping_from_json(masking.F.col("j")).alias("m")).first().m
    assert [(e.token, e.term) for e in back.entries] == [("<A_1A>", "New  York"), ("<N_1A>", "12"), ("<N_2A>", "york 55")]


WORDS = st.lists(st.sampled_from(["CORP", "corp", "알파테크", "알파", "x", "<A_1>", "010-1234-5678", " ", ".", "a@b.co", "오로라"]), max_size=12).map(" ".join)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(WORDS, min_size=20, max_size=20))
def test_round_trip(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    rows = masking.restore(guard.guarded(masking.mask(df, "text", PARITY), "masked", PARITY), "masked", "entries").collect()
    for r in rows:
        assert not r.leak and r.restored_text.lower() == texts[r.k].lower()


def test_known_tokens_stay(spark):
    """A token that the session gave in an earlier string is left alone, one that it didn't give is escaped."""
    df = spark.createDataFrame([(["CORP", "<CUSTOMER_1A> of <CUSTOMER_2A> <<CUSTOMER_1A>>", None, ""],)], "t array<string>")
    row = masking.mask_strings(df, "t", PARITY).first()
    assert row.masked == ["<CUSTOMER_1A>", "<CUSTOMER_1A> of <<CUSTOMER_2A>> <<CUSTOMER_1A>>", None, ""]
