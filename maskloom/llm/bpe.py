"""Operator 10: byte-pair encoding by a tokenization automaton.

The merges are compiled, one gadget after the other, into a deterministic automaton over tokens
whose paths are exactly the right encodings. The automaton before any merge has one state with an
arc for each byte. The gadget of the merge u v -> w, applied to it,

* takes the arc v out of the state that u leads to (u v may not follow each other any more),
* gives the arc w to every state that has the arc u,
* makes the state that w leads to a copy of the one that v led to.

The state after a token depends on that token only, so that the table has one row for each token.
A row keeps the moments at which its own arcs were taken out; older ones it has from the row it was
copied from. A word is encoded by one walk: from each position, arcs whose labels spell the next
symbols are followed; exactly one path reaches each position. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.llm.shared import release_memory

#: Fixed value: the file's pre-split pattern for which a shorter one does the same on lower-case ASCII.
CONTRACTIONS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Entries of each of the two generations of a worker's word cache.
CACHE_WORDS = 150_000
#: Words of up to STEPS bytes are encoded together, LANES at a time; the chunks of TEXTS texts are looked up together.
STEPS, LANES, TEXTS = 64, 20_000, 500
_NEVER = 1 << 60
#: Separators that str.split() knows and the tokenizer's \s doesn't.
_OWN_SPACES = "\x1c\x1d\x1e\x1f"
#: Letters, numbers and lower case that Unicode 15.1, which Python has, doesn't have yet.
LATER_LETTERS = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
LATER_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
LATER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_MAYBE_LATER = re.compile("[\u1c89\ua7cb-\ua7dc\U00010d50-\U0010ffff]")
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(rest)) for b in range(256)]


def _class(major: str, later: str) -> str:
    """The characters of a general category, as the inside of a character class."""
    member = [unicodedata.category(chr(c))[0] == major for c in range(0x110000)] + [False]
    for part in later.split():
        a, _, b = part.partition("-")
        for c in range(int(a, 16), int(b or a, 16) + 1):
            member[c] = True
    edges = [c for c in range(0x110001) if member[c] != (c > 0 and member[c - 1])]
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


class _Table:
    """Integer keys to integer values in arrays, open addressing; absent keys give -1."""

    def __init__(self, entries: dict[int, int]):
        self.shift = np.uint64(64 - (8 * len(entries) + 8).bit_length())
        self.keys = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.values = np.full(len(self.keys), -1, np.int32)
        self.mask = len(self.keys) - 1
        for at, key, value in zip(self._slots(np.fromiter(entries, np.int64)).tolist(), entries, entries.values(), strict=True):
            while self.keys[at] >= 0:
                at = at + 1 & self.mask
            self.keys[at], self.values[at] = key, value

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slots(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = at[left] + 1 & self.mask
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class MergeAutomaton:
    """The compiled merges of a tokenizer file's model. Immutable once built.

    Symbols are a byte inside of a word (0 to 255) or at its end (256 to 511).
    """

    def __init__(self, model: dict):
        vocab: dict[str, int] = model["vocab"]
        suffix: str = model["end_of_word_suffix"] or ""
        self.final = 256 if suffix else 0
        n = max(vocab.values()) + 2
        self.start = n - 1  # stands for the state before any token
        left, right, born = ([-1] * n for _ in range(3))
        self.left, self.right, self.born, self.length = left, right, born, [1] * n
        self.taken: dict[int, int] = {}  # state << 20 | arc -> the gadget that took it out
        symbols = byte_symbols()
        spelled = {vocab[c]: (b,) for b, c in enumerate(symbols) if c in vocab}
        spelled |= {vocab[c + suffix]: (256 + b,) for b, c in enumerate(symbols) if suffix and c + suffix in vocab}
        for k, merge in enumerate(model["merges"]):
            u, v = merge.split(" ") if isinstance(merge, str) else merge
            a, b, w = vocab[u], vocab[v], vocab[u + v]
            if born[w] >= 0 or max(born[a], born[b]) >= k:
                raise ValueError(f"merge {k} makes a token twice or before its parts")
            self.taken[a << 20 | b] = k
            left[w], right[w], born[w] = a, b, k
            spelled[w] = spelled[a] + spelled[b]
            self.length[w] = len(spelled[w])
        self._spell(spelled, n)
        self._left, self._right, self._born, self._length = (np.array(x, np.int64) for x in (left, right, born, self.length))
        self._taken = _Table(self.taken)

    def _spell(self, spelled: dict[int, tuple[int, ...]], n: int) -> None:
        """The labels' tree with failure links: child, fail, and the longest label that ends at a node;
        shorter: of a label the longest other one that ends with it."""
        child: dict[int, int] = {}
        token, depth_first = [-1], [[]]
        for word in spelled.values():
            node = 0
            for s in word:
                following = child.get(node << 9 | s)
                if following is None:
                    following = child[node << 9 | s] = len(token)
                    token.append(-1)
                    depth_first.append([])
                    depth_first[node].append((s, following))
                node = following
        for t, word in spelled.items():
            node = 0
            for s in word:
                node = child[node << 9 | s]
            token[node] = t
        fail, longest, shorter = [0] * len(token), token[:], [-1] * n
        level = [x for _, x in depth_first[0]]
        while level:
            following = []
            for node in level:
                if token[node] >= 0:
                    shorter[token[node]] = longest[fail[node]]
                else:
                    longest[node] = longest[fail[node]]
                for s, x in depth_first[node]:
                    f = fail[node]
                    while f and f << 9 | s not in child:
                        f = fail[f]
                    fail[x] = child.get(f << 9 | s, 0)
                    following.append(x)
            level = following
        self.child, self.fail, self.longest, self.shorter = child, fail, longest, shorter
        self._child = _Table(child)
        self._fail, self._longest, self._shorter = (np.array(x, np.int64) for x in (fail, longest, shorter))

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the final automaton has an arc for token in the state after the token `state`.

        Goes back through the gadgets, latest first: the state to the one that it was copied from, the arc
        to the one that it was added beside; no gadget of the time may have taken the arc out.
        """
        taken, born = self.taken, self.born
        limit = _NEVER
        while True:
            k = taken.get(state << 20 | token)
            if k is not None and k < limit:
                return False
            copied, added = born[state], born[token]
            if copied > added:
                limit, state = copied, self.right[state]
            elif added >= 0:
                limit, token = added + 1, self.left[token]
            else:
                return True

    def _have_arcs(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """has_arc of many pairs at once."""
        out = np.ones(len(state), bool)
        limit, left = np.full(len(state), _NEVER), np.arange(len(state))
        while len(left):
            k = self._taken.find(state << 20 | token)
            bad = (k >= 0) & (k < limit)
            out[left[bad]] = False
            copied, added = self._born[state], self._born[token]
            back = copied > added
            on = ~bad & (back | (added >= 0))
            limit = np.where(back, copied, added + 1)[on]
            state, token, left = np.where(back, self._right[state], state)[on], np.where(back, token, self._left[token])[on], left[on]
        return out

    def encode(self, word: bytes) -> list[int]:
        """The tokens of one pre-split word, not empty."""
        n = len(word)
        last = [self.start] + [-1] * n
        node, length = 0, self.length
        for end, s in enumerate(word, 1):
            s += self.final if end == n else 0
            while (following := self.child.get(node << 9 | s)) is None and node:
                node = self.fail[node]
            node = following
            token = self.longest[node]
            while not self.has_arc(last[end - length[token]], token):
                token = self.shorter[token]
            last[end] = token
        out = []
        while n > 0:
            out.append(last[n])
            n -= length[last[n]]
        return out[::-1]

    def encode_all(self, words: list[bytes]) -> list[bytes]:
        """encode() of many words, each as 32-bit integers: all take the step for their next symbol together."""
        out: list = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for k in np.flatnonzero(sizes > STEPS).tolist():
            out[k] = np.array(self.encode(words[k]), np.int32).tobytes()
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] <= STEPS]
        for k in range(0, len(order), LANES):
            part = order[k : k + LANES]
            for i, tokens in zip(part.tolist(), self._lanes([words[i] for i in part.tolist()], sizes[part]), strict=True):
                out[i] = tokens
        return out

    def _lanes(self, words: list[bytes], sizes: np.ndarray) -> list[bytes]:
        """Words of falling length: those that have a j-th symbol come first."""
        steps = int(sizes[0])
        symbols = np.zeros((len(words), steps), np.int64)
        symbols[np.arange(steps) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        symbols[np.arange(len(words)), sizes - 1] += self.final
        symbols = np.ascontiguousarray(symbols.T)
        last = np.full((steps + 1, len(words)), self.start, np.int64)
        nodes = np.zeros(len(words), np.int64)
        for j in range(steps):
            n = int(np.searchsorted(-sizes, -j, side="left"))
            node, s = nodes[:n], symbols[j, :n]
            following = self._child.find(node << 9 | s)
            left = np.flatnonzero(following < 0)
            while len(left):
                node[left] = self._fail[node[left]]
                following[left] = self._child.find(node[left] << 9 | s[left])
                left = left[following[left] < 0]
            node[:] = following
            left, token = np.arange(n), self._longest[node]
            while len(left):
                good = self._have_arcs(last[j + 1 - self._length[token], left], token)
                last[j + 1, left[good]] = token[good]
                left, token = left[~good], self._shorter[token[~good]]
        at, lanes, tokens = sizes.copy(), np.arange(len(words)), []
        while at[0] or at.any():
            found = np.where(at > 0, last[at, lanes], -1)
            tokens.append(found)
            at -= np.where(at > 0, self._length[found], 0)
        rows = np.stack(tokens[::-1], axis=1)
        flat, counts = rows[rows >= 0].astype(np.int32).tobytes(), 4 * (rows >= 0).sum(axis=1)
        ends = np.cumsum(counts).tolist()
        return [flat[e - c : e] for e, c in zip(ends, counts.tolist(), strict=True)]


class WordEncoder:
    """Texts to tokens: special tokens, normal form, pre-split, automaton; keeps frequent words."""

    def __init__(self, spec: dict):
        self.automaton = MergeAutomaton(spec["model"])
        self.labels = {v: k for k, v in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels |= {v: k for k, v in self.special.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        pattern_name = pattern
        for name, inside in (("\\s", _SPACE), ("\\p{L}", _class("L", LATER_LETTERS)), ("\\p{N}", _class("N", LATER_NUMBERS))):
            pattern = pattern.replace(name, inside)
        self.pieces = re.compile(pattern + "| ")
        self.ascii_pieces = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \\t-\\ra-z0-9]+| ") if pattern_name == CONTRACTIONS_PATTERN else self.pieces
        self.spaces = re.compile(f"[{_SPACE}]+")
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The tokens of each text as 32-bit integers."""
        out = []
        for k in range(0, len(texts), TEXTS):
            split = [self._chunks(t) for t in texts[k : k + TEXTS]]
            if len(self.words) > CACHE_WORDS:
                self.older, self.words = self.words, {}
            self._learn({c for chunks in split for c in chunks if c not in self.words})
            tokens = self.words.__getitem__
            out += [b"".join(map(tokens, chunks)) for chunks in split]
        return out

    def _chunks(self, text: str | None) -> list[str]:
        """The runs without white space."""
        if not text:
            return []
        return text.split() if not any(c in text for c in _OWN_SPACES) else [x for x in self.spaces.split(text) if x]

    def _learn(self, chunks: set[str]) -> None:
        """Put the tokens of chunks into self.words."""
        older, words, marked, plain = self.older, self.words, [], []
        for c in chunks:
            ids = older.get(c)
            if ids is not None:
                words[c] = ids
            elif "<|" in c:
                marked.append((c, [p for p in self.special_split.split(c) if p]))
            else:
                plain.append(c)
        plain += [p for _, parts in marked for p in parts if p not in self.special]
        words.update(zip(plain, self._plain(plain), strict=True))
        for c, parts in marked:
            words[c] = b"".join(np.int32(self.special[p]).tobytes() if p in self.special else words[p] for p in parts)

    def _plain(self, chunks: list[str]) -> list[bytes]:
        """The tokens of chunks without special tokens. Neither normal form nor pieces reach across a space."""
        if not chunks:
            return []
        order = sorted(range(len(chunks)), key=lambda k: not chunks[k].isascii())  # those of ASCII first
        n = sum(map(str.isascii, chunks))
        plain = " ".join([chunks[k] for k in order[:n]])
        other = unicodedata.normalize("NFC", " ".join([chunks[k] for k in order[n:]])).replace("Σ", "σ")
        if _MAYBE_LATER.search(other):
            other = other.translate(LATER_LOWER)
        pieces = self.ascii_pieces.findall(plain.lower())
        if n and n < len(chunks):
            pieces.append(" ")
        pieces += self.pieces.findall(other.lower())
        different = list(dict.fromkeys(pieces))
        tokens = dict(zip(different, self.automaton.encode_all([p.encode() for p in different]), strict=True))
        tokens[" "] = b" "  # no token array has one byte
        found, ids = [], b""
        for more in map(tokens.__getitem__, pieces):
            if len(more) == 1:
                found.append(ids)
                ids = b""
            else:
                ids = ids + more if ids else more
        found.append(ids)
        out = [b""] * len(chunks)
        for k, ids in zip(order, found, strict=True):
            out[k] = ids
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


@cache
def _encoder(spec_json: str) -> WordEncoder:
    gc.disable()  # nothing that is built here is garbage
    try:
        return WordEncoder(json.loads(spec_json))
    finally:
        gc.freeze()
        gc.enable()
        release_memory()


class Tokenizer:
    """Column functions for the tokenizer file at path, which only the driver reads; the executors get it
    as a broadcast (a vocabulary file has a fixed size) and compile it once in each Python worker."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            spec = spark.sparkContext.broadcast(f.read())

        @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
        def encode(text: pa.Array) -> pa.Array:
            encoder = _encoder(spec.value)
            sizes, flat = [0], []
            for k in range(0, len(text), TEXTS):  # a batch is never a list as a whole
                rows = encoder.encode_all(text.slice(k, TEXTS).to_pylist())
                sizes += [len(r) // 4 for r in rows]
                flat.append(b"".join(rows))
            ends = np.cumsum(sizes).astype(np.int32)
            return pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(flat), np.int32)).cast(pa.list_(pa.field("element", pa.int32(), False)))

        @F.arrow_udf(T.StringType())
        def decode(ids: pa.Array) -> pa.Array:
            encoder = _encoder(spec.value)
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).tolist()
            at = [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]
            return pa.chunked_array([pa.array([encoder.decode(flat[x].tolist()) for x in at[k : k + TEXTS]], pa.string()) for k in range(0, len(at), TEXTS)], pa.string()).combine_chunks()

        self._encode, self._decode = encode, decode

    def encode(self, text: Column) -> Column:
        """array<int>; null and empty texts have no tokens."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """The labels of the tokens, joined by a space as the file names no decoder; a null array gives an empty text."""
        return self._decode(ids)


def tokenize(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with token_ids and decoded, a row for each row; columns of these names are replaced. Rows come in parts of
    TEXTS, so that a worker never holds the tokens of a whole batch."""
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = [f for f in docs.schema.fields if f.name not in ("token_ids", "decoded")]
    schema = T.StructType([*kept, T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])
    ids_type = pa.list_(pa.field("element", pa.int32(), False))

    def run(batches):
        encoder = _encoder(spec.value)
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                ids = [np.frombuffer(x, np.int32) for x in encoder.encode_all(part.column(text).to_pylist())]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                columns = {f.name: part.column(f.name) for f in kept}
                columns["token_ids"] = pa.ListArray.from_arrays(ends, np.concatenate(ids)).cast(ids_type)
                columns["decoded"] = pa.array([encoder.decode(x.tolist()) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            release_memory()

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    rows = tokenize(docs.select("doc_id", "text"), path).select("doc_id", "token_ids", "decoded")
    return rows.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
