"""The stages one after the other: columns, what goes and what stays."""

import random

import corpus_pipeline
import test_lines
import test_mixing
import test_ngrams
from maskloom.llm import langid, ngrams, queries


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append((name, docs.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
        if name == "lines":
            lines = [x.strip().lower() for r in docs.collect() for x in r.text.split("\n") if x.strip()]
            assert len(lines) == len(set(lines))
        if name == "near_duplicates":
            found = ngrams.near_duplicates(docs).filter("n_shingles > 0")
            assert found.filter("doc_id <> component_id").count() == 0
    assert docs.columns == [*columns, "token_ids", "decoded"] and seen[0][1] >= 190 and docs.filter("size(token_ids) = 0").count() == 0


def test_every_stage_against_a_plain_computation(spark, tmp_path):
    """Small tables with null and empty texts, repeated rows, null ids and a further column of a name used inside."""
    rnd = random.Random(3)
    words = {"en": "the rain and wind of night".split(), "de": "der regen und die nacht".split(), "fr": "la pluie et le vent".split()}
    line = lambda lang: " ".join(rnd.choice(words[lang]) + str(rnd.randrange(400)) for _ in range(rnd.choice([4, 9, 15])))
    rows = []
    for k in range(120):
        lang = rnd.choice(sorted(words))
        rows.append((k, "\n".join(line(lang) for _ in range(rnd.randint(1, 4))), lang, rnd.choice(["a", "b", None])))
    rows += [(200 + k, rows[k][1] + ("\nThe End of it" if k % 2 else ""), rows[k][2], "b") for k in range(25)]
    rows += [(300, None, "en", "a"), (301, "", None, "a"), (302, "12 34", "de", None), (5, *rows[5][1:]), (None, "la nuit et la pluie de nuit", "fr", "b")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone string"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "g") for r in rows], schema)
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)

    def after(name, df):
        stages[name](spark, df, None).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns[: len(columns)] == columns and stages[name](spark, df.limit(0), None).count() == 0
        return out, [tuple(r) for r in out.collect()]

    key = lambda rows: sorted(rows, key=str)
    known, got = after("language", docs)
    rejected = [r.rejected for r in langid.identify(docs).select("language.rejected").collect()]
    assert key(got) == key(tuple(r) for r, x in zip(docs.collect(), rejected, strict=True) if not x)
    assert len(got) >= 140 and not any(r[1] in (None, "", "12 34") for r in got)

    single, got = after("lines", known)
    before = list(dict.fromkeys(r[:2] for r in known.collect()))
    texts, _ = test_lines.brute(sorted(before, key=lambda r: (r[0] is None, r[0] or 0)))
    texts = dict(zip(sorted(before, key=lambda r: (r[0] is None, r[0] or 0)), texts, strict=True))
    want = [(r[0], t, *r[2:4], len(t), r[5]) for r in map(tuple, known.collect()) if (t := texts[r[0], r[1]]).split()]
    assert key(got) == key(want)

    apart, got = after("near_duplicates", single)
    found = test_ngrams.brute([tuple(r[:2]) for r in single.collect()])
    kept = {k for k, n, c in found if k is not None and (k == c or n == 0)}
    assert key(got) == key(r for r in map(tuple, single.collect()) if r[0] is None or r[0] in kept)

    mixed, got = after("mixture", apart)
    taken = {}
    for doc, size, _, _, n in test_mixing.plain([(r[0], r[3], r[1]) for r in map(tuple, apart.collect())]):
        taken[doc] = taken.get(doc, 0) + n
    said = dict.fromkeys(taken, 0)
    for r in got:
        said[r[0]] += len(r[1].split())
    assert said == taken

    _, got = after("tokens", mixed)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    plain.no_truncation()
    plain.no_padding()
    for r in got:
        ids = plain.encode(r[1], add_special_tokens=False).ids
        assert (r[-2], r[-1]) == (ids, plain.decode(ids, skip_special_tokens=False))
