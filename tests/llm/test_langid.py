"""Held-out accuracy, subwords against a plain loop, edges."""

import tracemalloc
import zlib

import numpy as np

from maskloom.llm import langid


def plain_subwords(text):
    b = b" " + text.lower().encode().translate(langid._WORDS) + b" "
    out = []
    for n in langid.ORDERS:
        for k in range(len(b) - n + 1):
            g = b[k : k + n]
            if 32 not in g[1:-1] and not (g[0] == 32 and g[-1] == 32):
                h = g[0] * langid._MULTIPLIERS[0] & 0xFFFFFFFF
                for j in range(1, n):
                    h = (h ^ g[j] + j + 1) * langid._MULTIPLIERS[j] & 0xFFFFFFFF
                out.append((h ^ h >> 15) * langid._MULTIPLIERS[0] % 2**32 >> 32 - langid.BUCKETS_LOG2)
    return sorted(out)


def test_subwords():
    texts = ["Été à Paris", "x", "--- a1b", "straße, ñandú!", "", "long " * 9]
    for size in (3, 7, 16, 40, 1000):
        got = [[] for _ in texts]
        for numbers, starts, joined in langid.slices(texts, size):
            hashed, valid = langid.subwords(joined)
            for k, at, end in zip(numbers, starts, [*starts[1:], None], strict=True):
                got[k] += np.concatenate([h[at:end][v[at:end]] for h, v in zip(hashed, valid, strict=True)]).tolist()
        assert [sorted(g) for g in got] == [plain_subwords(t) for t in texts], size


def test_long_texts_need_no_more_memory():
    model = langid.fit([("en", "the rain and the wind"), ("de", "der regen und der wind")] * 20)
    text = "the wind and der regen " * 100_000
    assert np.allclose(model.logits([text, "x y"]), model.logits([text, "x y"], 1 << 30), atol=1e-4)
    tracemalloc.start()
    model.logits([text])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20


def test_sample_is_bounded_and_repeats(spark):
    """Many rows of one id, many equal rows, more languages than are learned."""
    rows = [(7, f"text {k}", "en") for k in range(300)] + [(8, "same", "de")] * 300 + [(k, f"t{k}", f"l{k}") for k in range(100, 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = langid.labelled_sample(docs, per_language=50, most=2)
    assert one == langid.labelled_sample(docs.repartition(5), per_language=50, most=2)
    assert {g for g, _ in one} <= {"en", "de"} and sum(g == "en" for g, _ in one) == 50 and one.count(("de", "same")) <= 1


def test_fit_and_reject():
    rows = [(("en", "de", "fr")[k % 3], ("the rain and the wind %d", "der regen und der wind %d", "la pluie et le vent %d")[k % 3] % k) for k in range(300)]
    model = langid.fit(rows)
    assert model.predict(["the wind", "der wind", "le vent", None, "", "123 %%"])[0] == ["en", "de", "fr", "und", "und", "und"]
    one_by_one = [model.logits([t])[0] for _, t in rows[:20]]
    assert np.allclose(one_by_one, model.logits([t for _, t in rows[:20]]))
    assert langid.fit([]).predict(["x"]) == (["und"], [0.0])
    assert langid.fit([("xx", "only one")]).predict(["anything"])[0] == ["xx"]


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, "s", 1), (90001, "", "en", "s", 1), (90002, "日本 123", None, None, 0), (90002, "日本 123", None, None, 0), (90003, "½ 123", "en", None, 0), (90004, "a" * 300_000, None, None, 0)], docs.schema)
    got = langid.digest(docs.unionByName(odd).withColumn("language", langid.F.lit(1))).toPandas()
    want = {r.doc_id: r.lang for r in docs.collect()}
    test = got[got.doc_id.isin(list(want)) & got.held_out]
    assert (test.lang_pred == test.doc_id.map(want)).mean() > 0.97 and not test.rejected.mean() > 0.01
    assert all(h == (zlib.crc32(str(int(d)).encode()) % 3 == 1) for d, h in zip(got.doc_id.dropna(), got[got.doc_id.notna()].held_out, strict=True))
    assert sorted(got[~got.doc_id.isin(list(want))].lang_pred) [-3:] == ["und"] * 3
    assert got.score.between(0, 1).all() and len(got) == 1006
    assert langid.digest(docs.limit(0)).count() == 0
    assert langid.accepted(docs).columns == docs.columns
