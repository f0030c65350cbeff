"""Operator 1: secret scans, with DataFrame functions only.

Three patterns give the base spans. Beside them, tokens that look machine-made are scored by two
character Markov models, one of random strings and one of ordinary identifiers: the sum over a
token's character pairs of log P(random) - log P(ordinary), for each pair. Both models are counts of
pairs in labelled samples, aggregated by Spark; their log ratios, some thousand numbers whatever the
corpus, are the only thing that the driver sees. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base kinds with their patterns, in the order of the reports.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")
#: Group 2 of an assignment has so many characters at least.
ASSIGN_LEAST = 6
#: What the models score: tokens of these characters with at least a digit and a letter.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}"
#: Characters of the models; any other one is the last class.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CLASSES = len(ALPHABET) + 1
#: A token is reported if its mean log-likelihood ratio for each pair is above this.
LEAST_RATIO = 0.35
#: Size of the labelled sample: random strings of each form, and identifiers.
SAMPLE = 4000
#: Words that ordinary identifiers are made of.
WORDS = (
    "get set user name file path data index count value list map key item order date time start end page test main init load save "
    "read write open close send recv buffer size length max min sum total error code status message result request response client "
    "server host port config option default parse format print string number float int bool array object class type table column row "
    "query filter group sort join merge split update delete insert create remove add find search match replace text line word char byte "
    "image color width height left right top bottom first last next prev node tree graph edge path root parent child event handler "
    "listener callback thread lock queue stack cache memory version build release debug log trace report customer account invoice "
    "payment product category price region country city street session context module package service manager factory helper util"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLE) -> DataFrame:
    """(random boolean, token string): random strings in base 64, hexadecimal and capital letters and digits, and
    identifiers of two to four words joined in the usual ways, some with a number. Made by rule from hashes,
    so every run has the same."""
    rows = spark.range(n).withColumn("h", F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 512))
    forms = [
        F.substring(F.regexp_replace(F.base64(F.unhex("h")), "[\r\n]", ""), 1, 40),
        F.substring("h", 1, 40),
        F.upper(F.substring(F.regexp_replace(F.base64(F.unhex("h")), "[^A-Za-z0-9]", ""), 1, 32)),
        F.substring(F.translate(F.base64(F.unhex("h")), "+/", "-_"), 1, 32),
    ]
    machine = rows.select(F.lit(True).alias("random"), F.explode(F.array(*forms)).alias("token"))
    words = F.array(*map(F.lit, WORDS))
    at = lambda k: F.element_at(words, (F.conv(F.substring("h", 1 + 4 * k, 4), 16, 10).cast("int") % len(WORDS) + 1))
    parts = F.slice(F.array(*(at(k) for k in range(4))), 1, F.conv(F.substring("h", 20, 2), 16, 10).cast("int") % 3 + 2)
    camel = F.array_join(F.transform(parts, F.initcap), "")
    number = F.concat(F.lit("_"), F.conv(F.substring("h", 24, 2), 16, 10))
    spelled = [F.array_join(parts, "_"), F.concat(F.array_join(parts, "_"), number), F.array_join(parts, "-"), camel, F.concat(camel, F.conv(F.substring("h", 30, 1), 16, 10)), F.upper(F.array_join(parts, "_")), F.concat(F.array_join(parts, "/"), F.lit("-2024-01-15")), F.array_join(parts, "")]
    return machine.unionByName(rows.select(F.lit(False).alias("random"), F.explode(F.array(*spelled)).alias("token")))


def _pair_classes(token: Column) -> Column:
    """The number of each character pair of token: CLASSES * class of the first + class of the second."""
    one = lambda c: F.pmod(F.instr(F.lit(ALPHABET), c) - 1, F.lit(CLASSES))
    pairs = F.regexp_extract_all(token, F.lit("(?s)(?=(..))."), F.lit(1))
    return F.transform(pairs, lambda p: one(F.substring(p, 1, 1)) * CLASSES + one(F.substring(p, 2, 1)))


def train(samples: DataFrame) -> list[float]:
    """log P(second | first, random) - log P(second | first, ordinary) of each pair number, with one added to
    every count. Samples without pairs have no influence."""
    pairs = samples.filter("length(token) > 1").select("random", F.explode(_pair_classes(F.col("token"))).alias("pair")).groupBy("random", "pair").count().collect()
    counts = {(r.random, r.pair): r["count"] for r in pairs}
    out = []
    for first in range(CLASSES):
        rows = {kind: [counts.get((kind, first * CLASSES + k), 0) + 1 for k in range(CLASSES)] for kind in (True, False)}
        totals = {kind: sum(row) for kind, row in rows.items()}
        out += [math.log(rows[True][k] / totals[True]) - math.log(rows[False][k] / totals[False]) for k in range(CLASSES)]
    return [round(x, 6) for x in out]


def mean_ratio(token: Column, ratios: list[float]) -> Column:
    """The mean log-likelihood ratio of a token's pairs; null for tokens of fewer than two characters."""
    table = F.expr(f"array({','.join(f'{x!r}D' for x in ratios)})")
    total = F.aggregate(_pair_classes(token), F.lit(0.0), lambda s, k: s + F.get(table, k))
    return F.when(F.length(token) > 1, total / (F.length(token) - 1))


#: Matches whose places are summed up at a time.
BLOCK = 256
_SPANS = "array<struct<start:int,kind_no:int,end:int,kind:string,token:string>>"


def _let(value: Column, use) -> Column:
    """use(value), where value is a name: else it would be written out, and computed, wherever it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, start: int, with_next) -> Column:
    """The running results of with_next(so far, next) over an array of numbers, from start on. In blocks, whose first
    values are known from the blocks before: growing one array for all would copy it for each element."""
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(BLOCK)), lambda k: F.slice(values, k, BLOCK))
    none, first = F.array().cast("array<bigint>"), F.lit(start).cast("long")

    def grown(numbers: Column) -> Column:
        last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), first)
        return F.aggregate(numbers, none, lambda acc, x: F.concat(acc, F.array(with_next(last(acc), x))))

    def joined(inner: Column) -> Column:
        ends = F.transform(F.slice(inner, 1, F.size(inner) - 1), lambda b: F.coalesce(F.get(b, F.size(b) - 1), first))
        before = F.concat(F.array(first), grown(ends))
        return F.flatten(F.zip_with(inner, before, lambda b, s: F.transform(b, lambda x: with_next(s, x))))

    return _let(F.transform(blocks, grown), joined)


def _spans(hits: Column, pieces: Column, kind: str, order: int, keep=None) -> Column:
    """The matches hits of a kind with their places, which the pieces between them give. keep: what a match must
    hold to stay."""
    none = F.array().cast(_SPANS)
    lengths = F.zip_with(F.slice(pieces, 1, F.greatest(F.size(hits), F.lit(1))), hits, lambda p, h: (F.length(p) + F.length(h)).cast("long"))
    ends = _running(lengths, 0, lambda s, x: s + x)

    def span(end: Column, hit: Column) -> Column:
        end = end.cast("int")
        return F.struct((end - F.length(hit)).alias("start"), F.lit(order).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), hit.alias("token"))

    found = F.zip_with(ends, hits, span)
    return F.when(F.size(hits) > 0, found if keep is None else F.filter(found, keep)).otherwise(none)


def _free(scored: Column, base: Column) -> Column:
    """Of spans that are sorted and apart those that no base span overlaps: the furthest end of the base spans that start
    before one, and the next start of one behind, tell it."""
    mark = lambda xs, is_base: F.transform(xs, lambda x: F.struct(x["start"].cast("long").alias("start"), F.lit(not is_base).alias("scored"), x["end"].cast("long").alias("end")))
    far = (1 << 31) - 1

    def alone(every: Column) -> Column:
        """For each scored span whether it is free."""
        reach = _running(F.transform(every, lambda x: F.when(x["scored"], F.lit(0)).otherwise(x["end"]).cast("long")), 0, lambda s, x: F.greatest(s, x))
        following = F.reverse(_running(F.reverse(F.transform(every, lambda x: F.when(x["scored"], F.lit(far)).otherwise(x["start"]).cast("long"))), far, lambda s, x: F.least(s, x)))
        told = F.zip_with(F.zip_with(every, reach, lambda x, r: F.struct(x.alias("x"), r.alias("reach"))), following, lambda y, n: F.when(y["x"]["scored"], (y["reach"] <= y["x"]["start"]) & (n >= y["x"]["end"])))
        return F.array_compact(told)

    free = _let(F.array_sort(F.concat(mark(base, True), mark(scored, False))), alone)
    kept = F.filter(F.zip_with(scored, free, lambda x, f: F.struct(x.alias("x"), f.alias("free"))), lambda z: z["free"])
    return F.transform(kept, lambda z: z["x"])


def find_secrets(docs: DataFrame, text: str = "text", ratios: list[float] | None = None) -> DataFrame:
    """docs with the column secret_spans (a column of that name is replaced), a row for each row: the spans by
    start, then kind, as array<struct<start, kind_no, end, kind, token>>.

    Null and empty texts have none. A token that a base span overlaps is not reported again by the models.
    ratios: what train() gave; without, the models are trained from labelled_samples().
    """
    ratios = ratios or train(labelled_samples(docs.sparkSession))
    kinds = dict(zip((*BASE_KINDS, "random"), (ASSIGN, ACCESS, HEX, TOKEN), strict=True))
    keep = {
        "assign": lambda x: F.length(F.regexp_extract(x["token"], ASSIGN, 2)) >= ASSIGN_LEAST,
        "random": lambda x: mean_ratio(x["token"], ratios) > LEAST_RATIO,
    }
    own = lambda what, k: f"__secret_{what}_{k}"
    # columns of their own, so that each pattern runs once over a text
    rows = docs.withColumns({own("hits", k): F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r), F.lit(0)) for k, r in kinds.items()})
    rows = rows.withColumns({own("pieces", k): F.when(F.size(own("hits", k)) > 0, F.split(F.col(text), r, -1)) for k, r in kinds.items()})
    rows = rows.withColumns({own("spans", k): _spans(F.col(own("hits", k)), F.col(own("pieces", k)), k, n, keep.get(k)) for n, k in enumerate(kinds)})
    rows = rows.withColumn(own("spans", "base"), F.concat(*(own("spans", k) for k in BASE_KINDS)))
    base, scored = F.col(own("spans", "base")), F.col(own("spans", "random"))
    # columns of their own again: what is written twice is computed twice
    both = (F.size(scored) > 0) & (F.size(base) > 0)
    rows = rows.withColumn(own("spans", "free"), F.when(both, _free(scored, base)).otherwise(scored))
    rows = rows.withColumn("secret_spans", F.array_sort(F.concat(base, F.col(own("spans", "free")))))
    return rows.drop(*(own(what, k) for what in ("hits", "pieces", "spans") for k in (*kinds, "base", "free")))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of docs(doc_id, text)."""
    rows = find_secrets(docs.select("doc_id", "text")).select("doc_id", "secret_spans")
    listed = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secret_spans", lambda x: x["kind"] != "random")
    return rows.select("doc_id", *map(of, BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"), of("random"))
