"""Operator 13: benchmark decontamination by one Aho-Corasick automaton.

Words are runs of ASCII letters and digits and of characters beyond ASCII, letters A-Z in lower case. A window are WINDOW
neighbouring words of a benchmark item, or all words of a shorter item. The automaton is built over the windows
of all items, its symbols are words; a text runs through it once, and what is found comes back as ranges of
words and as code points of the original text.

Items are cut into segments with all windows, and segments into blocks of BLOCK words and bytes, of which one
is held in a worker at a time. A benchmark of one block, some thousand items, takes one pass over the documents and no
shuffle. A larger one takes a pass for each block, each of which adds to what the earlier ones found.
"""

from __future__ import annotations

import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.shared import fresh_name, saved

#: Words of a window.
WINDOW = 10
#: Windows of a segment of an item.
SEGMENT = 1000
#: Words in all windows and bytes of a block: some 150 MB in a worker, and so much once in the driver.
BLOCK = 3_000_000
#: Bytes of a text that are cut into words at a time.
SLICE = 1 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of UTF-8: letters in lower case, digits and bytes beyond ASCII as they are, all others a space.
_FOLDED = bytes(b if b >= 128 or chr(b) in _LOWER + "0123456789" else b + 32 if chr(b) in _UPPER else 32 for b in range(256))

FOUND = "struct<n_words:bigint,ranges:array<struct<first:bigint,last:bigint>>,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"
_RANGES = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_FOUND = pa.struct([("n_words", pa.int64()), ("ranges", _RANGES), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def segments(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, words, cost: each item's words in segments that hold each window once; items without words have none."""
    words = F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    rows = benchmark.select(F.col(item).cast("string").alias("item"), words.alias("words")).filter("size(words) > 0")
    firsts = F.sequence(F.lit(1), F.greatest(F.size("words") - WINDOW + 1, F.lit(1)), F.lit(SEGMENT))
    rows = rows.select("item", F.explode(F.transform(firsts, lambda k: F.slice("words", k, SEGMENT + WINDOW - 1))).alias("words")).distinct()
    windows = F.greatest(F.size("words") - WINDOW + 1, F.lit(1))
    return rows.withColumn("cost", (windows * WINDOW + F.length(F.encode(F.array_join("words", " "), "UTF-8"))).cast("long"))


def _blocks(segs: DataFrame, most: int) -> tuple[DataFrame, int]:
    """segs with block, and the number of blocks; each costs about as much as most, or is one segment."""
    total, largest = segs.agg(F.coalesce(F.sum("cost"), F.lit(0)), F.coalesce(F.max("cost"), F.lit(0))).first()
    n = -(-total // most)
    while True:
        rows = segs.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(max(n, 1))))
        if n <= 1 or rows.groupBy("block").agg(F.sum("cost").alias("cost")).agg(F.max("cost")).first()[0] <= most + largest:
            return rows, n
        n *= 2


class Automaton:
    """The windows of some segments (item, words) as an automaton over numbers of words."""

    def __init__(self, rows: list[tuple[str | None, list[str]]]):
        import ahocorasick

        self.words: dict[bytes, int] = {}
        self.lengths: list[int] = []
        self.items: list[set[str]] = []  # of each window
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        known: dict[tuple[int, ...], int] = {}
        for item, words in rows:
            numbers = [self.words.setdefault(w.encode(), len(self.words) + 1) for w in words]
            for k in range(max(len(numbers) - WINDOW + 1, 1)):
                window = tuple(numbers[k : k + WINDOW])
                if window not in known:
                    known[window] = len(known)
                    self.lengths.append(len(window))
                    self.items.append(set())
                    self.found.add_word(window, known[window])
                if item is not None:
                    self.items[known[window]].add(item)
        self.found.make_automaton()

    def scan(self, folded: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """(number of words, ranges of words that are hit, the windows found) of a text as _FOLDED gives it."""
        n, ranges, windows = 0, [], set()
        walk = self.found.iter(()) if self.lengths else None
        for part in _parts(folded):
            numbers = tuple(map(self.words.get, part.split(), repeat(0)))
            n += len(numbers)
            if not walk:
                continue
            walk.set(numbers)
            for last, window in walk:
                windows.add(window)
                _add(ranges, last - self.lengths[window] + 1, last)
        return n, ranges, windows


def _parts(folded: bytes):
    """A text in slices that end at a space."""
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE)
        end = len(folded) if end < 0 else end
        yield folded[at:end]
        at = end


def _add(ranges: list[tuple[int, int]], first: int, last: int) -> None:
    """Put a range that ends behind all others into the list, so that none overlap or touch."""
    while ranges and first <= ranges[-1][1] + 1:
        first, last = min(first, ranges[-1][0]), max(last, ranges.pop()[1])
    ranges.append((first, last))


def _spans(raw: bytes, folded: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) in code points of ranges of words."""
    ends, n, chars, at = [], 0, 0, 0
    firsts, lasts = (np.array(x) for x in zip(*ranges, strict=True))
    starts = []
    for part in _parts(folded):
        word = np.frombuffer(part, np.uint8) != 32
        edges = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
        # code points before each byte
        points = chars + np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.uint8, len(part), at) & 0xC0 != 0x80)))
        for wanted, told, edge in ((firsts, starts, edges[::2]), (lasts, ends, edges[1::2])):
            here = wanted[(wanted >= n) & (wanted < n + len(edge))]
            told += points[edge[here - n]].tolist()
        n, chars, at = n + len(edges) // 2, int(points[-1]), at + len(part)
    return list(zip(starts, ends, strict=True))


_built: tuple[str, Automaton] | None = None  # the automaton of a worker's last block


def _automaton(key: str, rows: Broadcast) -> Automaton:
    global _built
    if _built is None or _built[0] != key:
        _built = None
        _built = key, Automaton(rows.value)
    return _built[1]


def _scanner(key: str, rows: Broadcast):
    """A column function (text, ranges and items found so far) -> FOUND."""

    @F.arrow_udf(FOUND)
    def scan(text: pa.Array, ranges: pa.Array, items: pa.Array) -> pa.Array:
        automaton, out = _automaton(key, rows), []
        for value, before, known in zip(text.cast(pa.binary()), ranges, items, strict=True):
            raw = value.as_py() or b""
            folded = raw.translate(_FOLDED)
            n, hit, windows = automaton.scan(folded)
            every = set(known.as_py() or ()).union(*(automaton.items[w] for w in windows))
            if before.is_valid and len(before):
                merged: list[tuple[int, int]] = []
                for first, last in sorted([*hit, *((x["first"], x["last"]) for x in before.as_py())]):
                    _add(merged, first, last)
                hit = merged
            spans = _spans(raw, folded, hit) if hit else []
            out.append({"n_words": n, "ranges": [{"first": a, "last": b} for a, b in hit], "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(every)})
        return pa.array(out, _FOUND)

    return scan


def scanned(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """docs with contamination: n_words; ranges, the words that lie in an occurrence of a window, numbered from 0, both
    ends included; spans, the same in code points, end exclusive; items, the ids as strings of the items found. A
    column contamination that docs has is replaced.

    Every row stays, repeated ones too. Null and empty texts and those without words have no range. Items without words
    find nothing, without an id they hit words but are not listed; items that share an id are one item.
    An empty benchmark finds nothing.
    """
    segs, n = _blocks(saved(segments(benchmark, item, item_text), "benchmark"), block)
    spark, name = docs.sparkSession, fresh_name(docs, "found")
    rows = docs.withColumn(name, F.lit(None).cast(FOUND))
    for k in range(max(n, 1)):
        if k:
            rows = saved(rows, "contamination")
        of_block = [(r["item"], r["words"]) for r in segs.filter(F.col("block") == k).select("item", "words").collect()]
        scan = _scanner(uuid.uuid4().hex, spark.sparkContext.broadcast(of_block))
        rows = rows.withColumn(name, scan(F.col(text), F.col(f"{name}.ranges"), F.col(f"{name}.items")))
    return rows.drop("contamination").withColumnRenamed(name, "contamination")


def n_hit(found: Column) -> Column:
    """How many words lie in an occurrence of a window."""
    return F.aggregate(found["ranges"], F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)


def without_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs whose text has no passage of the benchmark: spans go, what is between them stays."""
    rows = scanned(docs, benchmark, text, **options)
    spans = F.col("contamination.spans")
    # from the end of each span to the start of the next one
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda x: x["end"]))
    ends = F.concat(F.transform(spans, lambda x: x["start"]), F.array(F.length(text).cast("long")))
    kept = F.zip_with(starts, ends, lambda a, b: F.substring(F.col(text), (a + 1).cast("int"), (b - a).cast("int")))
    return rows.withColumn(text, F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(F.col(text))).drop("contamination")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    rows = scanned(docs.select("doc_id", "text"), benchmark).select("doc_id", "contamination")
    found = F.col("contamination")
    return rows.select(
        "doc_id",
        found["n_words"].alias("n_words"),
        n_hit(found).alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["items"], ","), 256).alias("items_sha256"),
        (F.size(found["ranges"]) > 0).alias("contaminated"),
    )


_WORDS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}')"
ORACLE_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS_SQL} AS w FROM documents),
  b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
  windows AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
  sizes AS (SELECT DISTINCT n FROM windows),
  here AS (SELECT k, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT k, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
  found AS (SELECT h.k, h.n, h.p, item_id FROM here h JOIN windows i ON i.win = h.win AND i.n = h.n),
  hits AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT k, n, p FROM found)) GROUP BY k),
  items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY k)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN hits USING (k) LEFT JOIN items USING (k)"""
