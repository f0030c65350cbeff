"""Operator 12: phrase collocation mining by level-wise Apriori passes.

Texts are in lower case (A-Z), cut at punctuation and line ends into pieces, and these into words. Level 1 counts
words, level k those phrases of k words whose two parts of k - 1 words are both frequent. Each level is a pass over
all texts: tasks of numpy and counters, added up by a shuffle of (group, phrase) with map-side sums.

What was frequent is broadcast as a bitmap of hashes. Its size follows their number up to 2 ** MAX_BITS bits, 32 MB; with more
frequent phrases, or with a hash that two phrases share, some phrases are counted in vain, and no count is ever
wrong, since phrases are counted by their text and each level keeps only frequent ones.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskloom.llm.shared import broadcast_if_few, forget, saved

#: Words of the longest phrases, and occurrences that a frequent one has at least.
LONGEST, LEAST = 4, 30
#: A phrase goes where a longer one has so many hundredths of its occurrences.
COVERED = 80
#: Rows of a group in the result.
TOP = 2000
SCALE = 2_000_000
MAX_BITS = 28
#: Bytes that are hashed at a time, and phrases that a task counts before it gives them on.
CHUNK, HELD = 1 << 20, 400_000
#: Parts into which the rows of a group are dealt before its first rows are told, and for the joins of large tables.
SALTS = 64
#: Bytes of UTF-8: letters in lower case, ends of pieces as line ends, tabs as spaces.
_FOLDED = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACES = re.compile(rb"  +")
_FACTOR, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hashes:
    """64-bit hashes of any stretches of a text: differences of the running sums of byte times power."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: str) -> np.ndarray:
        if len(self.up) <= len(text):
            self.up, self.down = (_powers(f, len(text) + 1) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.up[: len(text)])))
        h = (sums[ends] - sums[starts]) * self.down[starts] + np.uint64(zlib.crc32(group.encode()) * _FACTOR % (1 << 64))
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(29))


def _chunks(text: bytes, k: int) -> Iterator[bytes]:
    """A text in chunks that end with a piece, or within a piece with a word; then the next chunk repeats the last k - 1
    words of the piece, so all k words that follow each other are in just one chunk."""
    begin = at = 0
    while at < len(text):
        end = at + CHUNK
        cut = len(text) if end >= len(text) else text.rfind(b"\n", at, end)
        if cut > at:
            yield text[begin:cut]
            begin = at = cut
            continue
        cut = text.rfind(b" ", at + 1, end)
        if cut < 0:  # a very long word
            cut = min((x for x in (text.find(b" ", end), text.find(b"\n", end)) if x >= 0), default=len(text))
        yield text[begin:cut]
        least, at = max(text.rfind(b"\n", begin, cut), begin), cut
        begin = cut
        for _ in range(k - 1):
            begin = max(text.rfind(b" ", least, begin), least)


def _words(chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number of the piece) of the words."""
    gap = (chunk == 32) | (chunk == 10)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    return edges[::2], edges[1::2], np.cumsum(chunk == 10, dtype=np.int32)[edges[::2]]


def _phrases(text: bytes, k: int, group: str, bits: np.ndarray | None, hashes: Hashes) -> Iterator[list[bytes]]:
    """The phrases of k words whose both parts are in the bitmap, in lists."""
    for chunk in _chunks(_SPACES.sub(b" ", text.translate(_FOLDED)), k):
        raw = np.frombuffer(chunk, np.uint8)
        starts, ends, piece = _words(raw)
        n = len(starts) - k + 1
        if n <= 0:
            continue
        if k == 1:
            yield [chunk[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            continue
        known = _in(bits, hashes.of(raw, starts[: n + 1], ends[k - 2 :], group))
        at = np.flatnonzero(known[:n] & known[1:] & (piece[:n] == piece[k - 1 :]))
        yield [chunk[a:b] for a, b in zip(starts[at].tolist(), ends[at + k - 1].tolist(), strict=True)]


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bits of hashes are set in a bitmap of a power of two of bytes."""
    at = h & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def _counter(k: int, shipped):
    """A function of mapInArrow: batches (lang, text) to counts (lang, phrase, f), with a null phrase for all words."""

    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counter in counts.items():
            phrases = pa.array(list(counter), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counter), pa.string()), phrases, pa.array(counter.values(), pa.int64())], schema=_COUNTED)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shipped.value if shipped else None
        hashes, counts, words = Hashes(), {}, Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                for phrases in _phrases(text.as_py(), k, lang, bits, hashes):
                    counts.setdefault(lang, Counter()).update(phrases)
                    words[lang] += len(phrases)
                    if sum(map(len, counts.values())) > HELD:
                        yield from rows(counts)
                        counts = {}
        yield from rows(counts)
        if k == 1:
            yield pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.nulls(len(words), pa.string()), pa.array(words.values(), pa.int64())], schema=_COUNTED)

    return count


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """The bitmap of the hashes of the phrases in frequent(lang, phrase): distributed ORs, of which at most
    2 ** MAX_BITS / 64 rows reach the driver."""
    wanted = 32 * max(frequent.count(), 1)
    n = 1 << min(max(wanted.bit_length(), 16), MAX_BITS)

    def slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            of: dict[str, list[bytes]] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                of.setdefault(lang, []).append(phrase)
            for lang, phrases in of.items():
                ends = np.cumsum([len(p) for p in phrases])
                h = hashes.of(np.frombuffer(b"".join(phrases), np.uint8), ends - [len(p) for p in phrases], ends, lang) & np.uint64(n - 1)
                yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (h & np.uint64(63))).view(np.int64))], names=["slot", "bits"])

    table = frequent.select("lang", "phrase").mapInArrow(slots, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(n // 64, np.int64)
    out[table.column("slot").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint8)


def levels(docs: DataFrame, text: str = "text", group: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """([frequent(lang, phrase, f) of 1 word, of 2 words, ...], totals(lang, n)): written tables. Null groups are und,
    null texts empty. forget() deletes the tables: the totals are part of the first one."""
    spark, out = docs.sparkSession, []
    texts = docs.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter("text <> ''")
    for k in range(1, longest + 1):
        bits = spark.sparkContext.broadcast(_bitmap(out[-1].filter("phrase IS NOT NULL"))) if out else None
        counted = texts.mapInArrow(_counter(k, bits), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        out.append(saved(counted.filter((F.col("f") >= least) | F.col("phrase").isNull()), f"phrases-{k}"))
        if bits:
            bits.destroy()
    return out, out[0].filter("phrase IS NULL").select("lang", F.col("f").alias("n"))


def _with_count(rows: DataFrame, part: str, counts: DataFrame, name: str) -> DataFrame:
    """rows with the column name: the count of their phrase part. Where counts is too large to be broadcast, rows of one
    part are dealt over SALTS tasks."""
    found = counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    few = broadcast_if_few(found, counts)
    if few is not found:
        return rows.join(few, ["lang", part])
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).join(salted, ["lang", part, "salt"]).drop("salt")


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of candidates(lang, phrase, f): each phrase at its lowest-scoring cut, the first of
    several. Exact: products are decimals."""
    words = F.split("phrase", " ")
    rows = candidates.select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    rows = rows.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"))
    rows = _with_count(_with_count(rows, "first", counts, "l"), "rest", counts, "r")
    score = F.expr(f"(CAST(a AS DECIMAL(19, 0)) * {SCALE}) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    best = rows.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _parts(candidates: DataFrame) -> DataFrame:
    """lang, phrase, longer: for each phrase inside of longer candidates the largest count of these."""
    words = F.col("w")
    inner = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda k: F.array_join(F.slice(words, k, n), " "))
    every = F.flatten(F.transform(F.sequence(F.lit(2), F.size(words) - 1), inner))
    rows = candidates.select("lang", "f", F.split("phrase", " ").alias("w")).filter("size(w) > 2").select("lang", "f", F.explode(every).alias("phrase"))
    return rows.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", top: int = TOP, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    Null texts are empty, null languages und. Repeated rows count again. A language without a frequent phrase has no
    row, an empty table gives an empty result. Ties of score go to the larger count, then to the phrase by its bytes.
    """
    found, totals = levels(docs, text, group, least)
    counts = found[0].filter("phrase IS NOT NULL").union(found[1]).union(found[2])
    candidates = found[1].union(found[2]).union(found[3])
    covered = F.col("longer").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * COVERED
    rows = scored(candidates, counts).join(_parts(candidates), ["lang", "phrase"], "left").filter(F.col("longer").isNull() | ~covered).drop("longer")
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    # a language's first rows are among the first rows of its parts
    some = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    rows = saved(rows.join(broadcast_if_few(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    forget(*found)
    return rows


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = rf"""WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM
    (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
  totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
  f AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase FROM
    (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM pieces, range(1, {LONGEST + 1}) t(k) WHERE len(w) >= k)) GROUP BY lang, k, phrase),
  cands AS (SELECT lang, phrase, f AS a, k AS n_words, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {LEAST}),
  cuts AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST((CAST(c.a AS HUGEINT) * {SCALE}) // (x.f + y.f) AS BIGINT) AS score FROM
    (SELECT *, unnest(range(1, n_words)) AS k FROM cands) c
    JOIN f x ON x.lang = c.lang AND x.k = c.k AND x.phrase = array_to_string(w[1:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.k = n_words - c.k AND y.phrase = array_to_string(w[c.k + 1:], ' ')),
  best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  inner_ones AS (SELECT lang, array_to_string(w[p:p + m - 1], ' ') AS phrase, max(a) AS longer FROM
    (SELECT lang, w, a, m, unnest(range(1, n_words - m + 2)) AS p FROM cands, range(2, {LONGEST}) t(m) WHERE m < n_words) GROUP BY ALL),
  kept AS (SELECT b.* FROM best b LEFT JOIN inner_ones i USING (lang, phrase) WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < {COVERED} * CAST(a AS HUGEINT)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
  SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}"""
