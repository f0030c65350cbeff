"""The automaton against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer as Library

from maskloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Hello, World!", "it's we'll I'd 'RE", "<|endoftext|>", "a<|startoftext|>b", "ΑΣ Σ ας", "İ", "é é", "\x1c\x1d", "a b c　d", "日本語テキスト", "😀👍🏽", "١٢٣ ½", "aaaaaaaaaaaaa", "x" * 3000, "<|END|>", "́x", "﻿", "\x00", "a​b", "ſK", "tion" * 50]


def library(text):
    ids = LIB.encode(text, add_special_tokens=False).ids
    return ids, LIB.decode(ids, skip_special_tokens=False)


LIB = Library.from_file(PATH)
LIB.no_truncation()
LIB.no_padding()


def test_against_the_library():
    enc = bpe.WordEncoder(json.load(open(PATH, encoding="utf-8")))
    rnd = random.Random(3)
    syllables = ["tion", "er", "the", "an", "é", "que", "sch", "ß", ".", ",", " ", "\n", "'s", "1", "Q", "ing", "ñ", "##", "<|", "aa", "o"]
    texts = ODD + ["".join(rnd.choice(syllables) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 0x2FF), rnd.randint(0x370, 0x5FF)])) for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    for t, row in zip(texts, enc.encode_all(texts), strict=True):
        ids = np.frombuffer(row, np.int32).tolist()
        assert (ids, enc.decode(ids)) == library(t), repr(t)


def test_single_words():
    enc = bpe.WordEncoder(json.load(open(PATH, encoding="utf-8"))).automaton
    words = [w.encode() for w in ["the", "aaaaaaaaaaa", "thereandereing", "é" * 40, "x" * 200, "q", "internationalisation"]]
    assert [enc.encode(w) for w in words] == [np.frombuffer(x, np.int32).tolist() for x in enc.encode_all(words)] == [library(w.decode())[0] for w in words]


def test_query_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "Hello you"), (5, "Hello you"), (5, "Hello you")] + [(10 + k, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, token_ids int")
    got = sorted(map(tuple, bpe.digest(docs, PATH).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for k, t in rows:
        ids, text = library(t or "")
        want.append((k, len(ids), sha(" ".join(map(str, ids))), sha(text)))
    assert got == sorted(want, key=str)
    assert bpe.digest(docs.limit(0), PATH).count() == 0
