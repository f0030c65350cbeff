"""Operator 3: language identification.

A text is the average of the embeddings of its hashed subwords (byte n-grams of its words, with
their borders); a linear softmax over that average names the language. Embeddings and weights are
learned together by stochastic gradient descent in numpy from a bounded sample of labelled rows. A
part of the sample that the descent does not see sets the temperature of the scores and the score
under which a prediction is rejected. Predictions see the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.llm.shared import release_memory

UNKNOWN = "und"
#: Hash buckets, dimensions and n-gram lengths (bytes) of the subwords.
BUCKETS_LOG2, DIMENSIONS, ORDERS = 16, 16, (2, 3, 4)
#: Bounds of the labelled sample that the driver fits on: rows for each language, characters of a row, and languages.
SAMPLE_PER_LANGUAGE, SAMPLE_CHARS, SAMPLE_LANGUAGES = 1000, 20_000, 500
#: Passes over the sample, first learning rate, every CALIBRATION-th row is kept for calibration.
EPOCHS, RATE, CALIBRATION = 6, 1.0, 5
#: Of the right predictions that the descent did not see, this share may score under the rejection's reference; and
#: the highest score under which a prediction is ever rejected.
REJECTED, MOST_DOUBT = 0.005, 0.7
#: Bytes of text that are turned into n-grams at a time.
SLICE = 1 << 19

#: Lower-cased bytes to themselves if they can be part of a letter, else to a space.
_WORDS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def encoded(text: str) -> bytes:
    """The bytes of a text between two spaces; what is no part of a letter is a space."""
    return b" " + text.lower().encode().translate(_WORDS) + b" "


def subwords(joined: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each n-gram length: the bucket at each position but the last three, which are only looked at, and which
    positions count."""
    b = np.frombuffer(joined, np.uint8)
    n = len(b) - 3
    space = b == 32
    hashed, valid = [], []
    h = b.astype(np.uint32) * np.uint32(_MULTIPLIERS[0])
    inner = np.zeros(n, bool)  # a space strictly inside
    for order in range(2, max(ORDERS) + 1):
        k = order - 1
        if order > 2:
            inner = inner | space[k - 1 : n + k - 1]
        h = (h[:n] ^ (b[k : n + k].astype(np.uint32) + np.uint32(order))) * np.uint32(_MULTIPLIERS[k])
        if order in ORDERS:
            hashed.append((h ^ h >> np.uint32(15)) * np.uint32(_MULTIPLIERS[0]) >> np.uint32(32 - BUCKETS_LOG2))
            valid.append(~inner & ~(space[:n] & space[k : n + k]))
    return hashed, valid


def slices(texts: list[str], size: int) -> Iterator[tuple[list[int], list[int], bytes]]:
    """(numbers of texts, where each begins, bytes with three more to look at) of some `size` bytes at a time: several
    short texts, or a part of a long one."""
    numbers, starts, parts, full = [], [], [], 0
    for k, text in enumerate(texts):
        b = encoded(text)
        if len(b) > size:
            for at in range(0, len(b), size):
                yield [k], [0], b[at : at + size + 3].ljust(min(size, len(b) - at) + 3)
            continue
        if full + len(b) > size:
            yield numbers, starts, b"".join([*parts, b"   "])
            numbers, starts, parts, full = [], [], [], 0
        numbers.append(k)
        starts.append(full)
        parts.append(b)
        full += len(b)
    if numbers:
        yield numbers, starts, b"".join([*parts, b"   "])


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages, or buckets x dimensions with weights
    weights: np.ndarray | None
    bias: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0

    def logits(self, texts: list[str], size: int = SLICE) -> np.ndarray:
        """Of texts that each have a letter. Memory is bounded by `size` bytes of n-grams, however long a text is."""
        total, n = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts))
        for numbers, at, joined in slices(texts, size):
            for hashed, valid in zip(*subwords(joined), strict=True):
                counts = np.add.reduceat(valid.astype(np.int64), at)
                places = np.flatnonzero(valid)
                # texts without a position of this length would take over their neighbour's
                some = np.flatnonzero(counts)
                first = np.concatenate([[0], np.cumsum(counts[some])[:-1]]).astype(np.intp)
                if len(some):
                    total[np.array(numbers)[some]] += np.add.reduceat(self.table[hashed[places]], first, axis=0)
                n[numbers] += counts
        mean = total / np.maximum(n, 1)[:, None]
        return (mean @ self.weights if self.weights is not None else mean) + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated score; UNKNOWN and 0 for null, for texts without a letter and for a model
        that has learned no language."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.languages else []
        if known:
            p = softmax(self.logits([texts[k] for k in known]) / self.temperature)
            best = p.argmax(axis=1)
            scores[known] = p[np.arange(len(known)), best]
            for k, j in zip(known, best.tolist(), strict=True):
                names[k] = self.languages[j]
        return names, np.clip(scores, 0.0, 1.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]]) -> LanguageModel:
    """A model from (language, text) rows, in an order that does not depend on the language. Texts without a
    letter are of no use and left out; no rows give a model that knows no language."""
    rows = [(g, t) for g, t in rows if g is not None and t and any(map(str.isalpha, t))]
    languages = sorted({g for g, _ in rows})
    if not languages:
        return LanguageModel([], np.zeros((1, 0)), None, np.zeros(0))
    number = {g: k for k, g in enumerate(languages)}
    features, targets = [], []
    for g, t in rows:
        buckets, counts = np.unique(np.concatenate([h[v] for h, v in zip(*subwords(encoded(t) + b"   "), strict=True)]), return_counts=True)
        features.append((buckets, (counts / counts.sum()).astype(np.float32)))
        targets.append(number[g])
    rng = np.random.default_rng(7)
    e = rng.uniform(-0.5, 0.5, (1 << BUCKETS_LOG2, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    w, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    kept = [k for k in range(len(rows)) if k % CALIBRATION] or list(range(len(rows)))
    steps, done = EPOCHS * len(kept), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(kept):
            (buckets, share), rate = features[k], np.float32(RATE * (1 - done / steps))
            x = share @ e[buckets]
            z = x @ w + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[targets[k]] -= 1
            back = w @ g
            w -= rate * np.outer(x, g)
            bias -= np.float32(0.1) * rate * g
            e[buckets] -= rate * np.outer(share, back) * np.float32(20)  # the share of one bucket is small
            done += 1
    model = LanguageModel(languages, e, w, bias) if len(languages) > DIMENSIONS else LanguageModel(languages, e @ w, None, bias)
    _calibrate(model, [rows[k] for k in range(len(rows)) if k % CALIBRATION == 0], number)
    return model


def _calibrate(model: LanguageModel, rows: list[tuple[str, str]], number: dict[str, int]) -> None:
    """The temperature of least log loss, against targets smoothed by the sample's size (a sample without an
    error must not make every score 1); predictions that score clearly lower than nearly all right ones (all but the
    share REJECTED) are rejected, so one odd row does not set the score."""
    z, y = model.logits([t for _, t in rows]), np.array([number[g] for g, _ in rows])
    doubt = 1 / (len(y) + 2)
    best = None
    for temperature in np.geomspace(0.05, 20, 60):
        p = softmax(z / temperature)
        logs = np.log(np.maximum(p, 1e-12))
        loss = -((1 - doubt) * logs[np.arange(len(y)), y] + doubt * logs.mean(axis=1)).mean()
        if best is None or loss < best[0]:
            best = loss, float(temperature)
    model.temperature = best[1]
    p = softmax(z / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    model.least_score = float(min(MOST_DOUBT, 0.9 * np.quantile(right, REJECTED))) if len(right) else 0.0


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 1 by 3. Null is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, chars: int = SAMPLE_CHARS, most: int = SAMPLE_LANGUAGES) -> list[tuple[str, str]]:
    """At most per_language different rows of each of the `most` languages with most rows, chosen by a hash of id and
    text, in hash order: a bounded sample, for the driver, that is the same in each run. Only rows that may be learned
    from count; rarer languages than these are not learned."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") <= chars) & ~held_out(F.col("doc_id")))
    rows = rows.select("doc_id", "lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("h"))
    # a little more than the quota passes the hash, the rest is cut off here
    counts = dict(map(tuple, rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()))
    if not counts:
        return []
    below = [(lang, int(min(1.0, 1.2 * per_language / n) * (1 << 30))) for lang, n in counts.items()]
    below = docs.sparkSession.createDataFrame(below, "lang string, below long")
    some = rows.join(F.broadcast(below), "lang").filter("h < below").select("h", "doc_id", "lang", "text").distinct()
    left, out = dict.fromkeys(counts, per_language), []
    for r in some.orderBy("h", "doc_id", "text", "lang").limit(2 * per_language * len(counts)).collect():
        if left[r.lang]:
            left[r.lang] -= 1
            out.append((r.lang, r.text))
    return out


def learn(docs: DataFrame) -> LanguageModel:
    return fit(labelled_sample(docs))


_PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def predictor(spark, model: LanguageModel):
    """A column function text -> struct(lang_pred, score, rejected). The model, some MB at most, is broadcast."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(_PREDICTION)
    def predict(text: pa.Array) -> pa.Array:
        names, scores = sent.value.predict(text.to_pylist())
        release_memory()
        refused = np.array([x == UNKNOWN for x in names], bool) | (scores < sent.value.least_score)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(refused, pa.bool_())], names=["lang_pred", "score", "rejected"])

    return predict


def identify(docs: DataFrame, model: LanguageModel | None = None, text: str = "text") -> DataFrame:
    """docs with the struct column language (lang_pred, score, rejected); a column of that name is replaced.
    Without a model one is learned from the columns doc_id, lang and text of docs."""
    predict = predictor(docs.sparkSession, model or learn(docs))
    return docs.withColumn("language", predict(F.col(text)))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: a row for each row of docs(doc_id, text, lang)."""
    rows = identify(docs.select("doc_id", "text", "lang")).select("doc_id", "language")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is predicted and not rejected, with the columns of docs."""
    predict = predictor(docs.sparkSession, learn(docs))
    return docs.filter(~predict(F.col("text"))["rejected"])
