"""SQL functions, provider files, dictionary files, guard modes, long texts and strings of a request for themselves."""

import time

import pytest

from maskloom.functions import sql
from maskloom.functions import text as X
from maskloom.operators import gateway, guard, jsonwalk, masking
from maskloom.plans import fixtures
from maskloom.sources import dictionary as D
from maskloom.sources import providers

F = masking.F
PARITY = D.parse_dictionary(fixtures.PARITY_YAML)


def test_sql_functions_agree_with_columns(spark):
    sql.register(spark, PARITY)
    texts = [v[1] for v in fixtures.PARITY_VECTORS if "<" not in v[1]] + ["corp CORP Corp 010-1234-5678", "Project  오로라 a@b.co", None]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").createOrReplaceTempView("said")
    got = {r.k: r for r in spark.sql("SELECT k, mask_text(t) AS m, mask_spans(t) AS s, restore_text(mask_text(t), map('<CUSTOMER_1A>', 'CORP')) AS r FROM said").collect()}
    want = masking.find_spans(masking.mask(spark.table("said"), "t", PARITY), "t", PARITY).collect()
    for r in want:
        assert got[r.k].m == r.masked and [tuple(x) for x in got[r.k].s] == [tuple(x)[:4] for x in r.spans], r
    rows = spark.sql("SELECT said.k, s.surface FROM said, LATERAL span_rows(coalesce(said.t, '')) s").collect()
    assert sorted((r.k, r.surface) for r in rows) == sorted((r.k, x.surface) for r in want for x in r.spans)


def test_many_hits_in_one_text(spark):
    d = D.parse_dictionary("N:\n  patterns: ['[0-9]+']")
    df = spark.createDataFrame([(" ".join(str(k) for k in range(20_000)),)], "text string")
    masking.mask(df.limit(0), "text", d).collect()
    began = time.time()
    row = masking.restore(masking.mask(df, "text", d), "masked", "entries").first()
    assert row.masked.endswith(" <N_20000A>") and row.restored_text == row.text and row.restored == 20_000
    assert time.time() - began < 20


def test_strings_of_a_request_stay_apart(spark):
    d = D.parse_dictionary("K:\n  patterns: ['key=[^ ]+']")
    body = '{"messages":[{"content":"key=abc\\u0001"},{"content":"def ghi key=abc\\u0001"}]}'
    df = spark.createDataFrame([(body, "openai"), ('{"a":[]}', "openai"), ("[", "openai")], "body string, dialect string")
    got = jsonwalk.mask_requests(df, d).collect()
    assert got[0].masked_body == '{"messages":[{"content":"<K_1A>"},{"content":"def ghi <K_1A>"}]}' and got[0].hits == {"K": 2}
    assert got[1].masked_body == '{"a":[]}' and got[2].masked_body is None and got[2].error
    back = jsonwalk.restore_responses(jsonwalk.mask_requests(df, d).select(F.col("masked_body").alias("body"), "dialect", "entries")).collect()
    assert back[0].restored_body == jsonwalk.dumps(__import__("json").loads(body))


def test_own_token_formats(spark):
    df = spark.createDataFrame([("CORP met CORP",)], "text string")
    rows = masking.mask(df, "text", PARITY, token_format="[{type}-{n}]")
    assert rows.first().masked == "[CUSTOMER-1A] met [CUSTOMER-1A]"
    assert masking.restore(rows, "masked", "entries", token_format="[{type}-{n}]").first().restored_text == "CORP met CORP"


def test_guard_modes(spark):
    df = spark.createDataFrame([("CORP",)], "masked string")
    assert guard.guarded(df, "masked", PARITY).first().masked is None
    assert tuple(guard.guarded(df, "masked", PARITY, mode="off").first()) == ("CORP", False)
    with pytest.raises(Exception, match="protected term"):
        guard.guarded(df, "masked", PARITY, mode="raise").collect()
    kept = spark.createDataFrame([("CORP", ["CORP"])], "masked string, kept array<string>")
    assert guard.guarded(kept, "masked", PARITY, bypassed="kept").first().masked == "CORP"
    assert not guard.guarded(df, "masked", D.Dictionary()).first().leak


def test_files(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("active: a\nproviders:\n  a: {endpoints: {openai: 'http://169.254.169.254/x'}}\n  b: {endpoints: {openai: 'https://b.example'}}\n")
    assert {r["name"]: r.problem for r in providers.load_providers(spark, str(tmp_path / "p.yaml")).collect()} == {"a": "host", "b": "ok"}
    for bad in ("x: [", "active: a", "active: z\nproviders: {a: {endpoints: {openai: u}}}", "active: a\nproviders: {a: {endpoints: {}}}", "active: a\nproviders: {a: {auth: api_key, endpoints: {openai: u}}}", "active: a\nproviders: {a: {endpoints: {other: u}}}"):
        with pytest.raises(providers.ProviderError):
            providers.parse_providers(bad)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.yaml").write_text("A: [first]\n")
    (tmp_path / "d" / "2.yaml").write_text("B:\n  patterns: ['[0-9]{4}', '[0-9]{4}']\n")
    both = D.load_dictionary(spark, str(tmp_path / "d"))
    assert [t.term for t in both.terms] == ["first"] and len(both.patterns) == 1


def test_small_functions(spark):
    row = spark.createDataFrame([("/Acme/v1/messages", {"Set-Cookie": "x", "X-Amzn-Id": "1", "A": "b"}, "a\r\n../b", "x y!가.z")], "u string, h map<string,string>, d string, n string")
    got = row.select(gateway.provider_prefix(F.col("u")).alias("p"), gateway.response_headers(F.col("h")).alias("h"), X.clean_disposition(F.col("d")).alias("d"), X.clean_import_name(F.col("n")).alias("n")).first()
    assert tuple(got.p) == ("acme", "/v1/messages") and got.h == {"a": "b"} and got.d == "ab" and got.n == "x y가.z"
    sent = row.select(gateway.outbound_headers(F.create_map(F.lit("anthropic-version"), F.lit("1\r\nX: 2")), F.lit("passthrough"), F.lit("k")).alias("h")).first().h
    assert sent == {"anthropic-version": "1 X: 2"}


def test_fast_reject(spark):
    d = D.parse_dictionary("A: [ab c, x-1]\nB:\n  patterns: ['[!]']")
    rows = spark.createDataFrame([("a",), ("가나다라",), ("ab",), ("AB   c!",), ("x-1",), ("",), (None,)], "t string")
    got = masking.mask(rows, "t", d).select("t", "masked", masking.may_hold_terms(F.col("t"), d).alias("may")).collect()
    assert [(r.may, r.masked) for r in got] == [(False, "a"), (False, "가나다라"), (False, "ab"), (True, "<A_1A><B_1A>"), (True, "<A_2A>"), (False, ""), (None, None)]
    assert spark.createDataFrame([("가나다",)], "t string").select(masking.may_hold_terms(F.col("t"), PARITY).alias("m")).first().m
