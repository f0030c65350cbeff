"""The store of mappings: order of merges, versions, conflicts, serialised mappings."""

from maskloom.operators import mappings, sessions
from maskloom.sources import dictionary as D

SCHEMA = "session string, token string, entity string, term string"
A = [("s", "<X_1A>", "X", "one"), ("s", "<X_2A>", "X", "two"), (None, "<X_1A>", "X", "none"), ("t", "<Y_1A>", "Y", "t")]
B = [("s", "<X_2A>", "X", "other"), ("s", "<X_3A>", "X", "three"), ("t", "<Y_1A>", "Y", "t"), ("t", "<Y_1A>", "Y", "t"), ("u", None, "Y", "u")]


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_either_order_gives_one_result(spark, tmp_path):
    a, b = spark.createDataFrame(A, SCHEMA), spark.createDataFrame(B, SCHEMA)
    one, other = f"{tmp_path}/one", f"{tmp_path}/other"
    assert mappings.stored(spark, one).collect() == []
    assert [mappings.upsert(x, one) for x in (a, b, a, b)] == [1, 2, 2, 2]
    assert [mappings.upsert(x, other) for x in (b, a)] == [1, 2]
    got = _rows(mappings.stored(spark, one))
    assert got == _rows(mappings.stored(spark, other))
    assert got == sorted([(*r, r[:2] == ("s", "<X_2A>")) for r in {*A, *B} if r[1]], key=str)
    assert _rows(mappings.stored(spark, one, 1)) == sorted([(*r, False) for r in A], key=str)
    texts = spark.createDataFrame([("s", "<X_1A> <X_2A> <X_3A>"), (None, "<X_1A> <X_3A>"), ("v", "<X_1A>")], "s string, m string")
    back = {r.s: (r.restored_text, r.restored) for r in mappings.restored(texts, "m", "s", one).collect()}
    assert back == {"s": ("one <X_2A> three", 2), None: ("none <X_3A>", 1), "v": ("<X_1A>", 0)}


def test_masked_sessions_through_the_store(spark, tmp_path):
    """Masked in two jobs, stored, serialised, and restored by a third one."""
    d = D.parse_dictionary("N:\n  patterns: ['[0-9]+']")
    rows = spark.createDataFrame([(k % 5, k, f"{k} and {k % 3}") for k in range(60)], "s long, o long, t string")
    path, masked = f"{tmp_path}/store", []
    for part in (rows.filter("s < 3"), rows.filter("s >= 3")):
        got, mapping = sessions.mask_sessions(part, "t", "s", "o", d)
        mappings.upsert(mapping, path, session="s")
        masked.append(got)
    back = mappings.restored(masked[0].union(masked[1]), "masked", "s", path).collect()
    assert all(r.restored_text == r.t and r.restored == 2 for r in back) and len(back) == 60
    entries = mappings.stored(spark, path).select(*mappings.COLUMNS)
    told = mappings.to_json_rows(entries)
    assert _rows(mappings.from_json_rows(told, "session", "mapping")) == _rows(entries)
    assert {r.mapping is None for r in mappings.to_json_rows(entries, most=3).collect()} == {True}
