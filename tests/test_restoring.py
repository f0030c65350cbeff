"""Finished streams on odd inputs, and what their query does for each chunk."""

from maskloom.plans import report_queries
from maskloom.streaming import restoring


def test_a_line_break_after_an_open_bracket():
    one = restoring.Restorer({"<A_1A>": "x"})
    assert [one.feed(c) for c in ("ab <\n", "c <", "A_1", "A>\n")] == ["ab <\n", "c ", "", "x\n"] and one.end() == ""


def test_query_keeps_empty_streams_and_makes_a_body_once(spark, tmp_path):
    texts = [("a", 0, "ab <\ncd", 0), ("a", 1, " e<e>", 0), ("b", 0, "", 0), ("c", 3, "é" * 400 + "e" * 50, 0)]
    spark.createDataFrame(texts, "conv_id string, turn long, text string, role long").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = report_queries.q_restore_bytes(spark, str(tmp_path))
    want = {"a": "ab <\ncd é€<é€>", "b": "", "c": "é" * 400 + "é€" * 50}
    assert {r.stream_id: (r.text, r.same) for r in rows.collect()} == {k: (v, True) for k, v in want.items()}
    lines = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
    made = [k for k, line in enumerate(lines) if "encode(" in line]
    assert made and all("posexplode" not in lines[k + 1] for k in made), "the body is encoded for each chunk"
