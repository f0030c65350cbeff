"""Operator 4: mixing sources to target weights, with DataFrame functions only.

Each row gets a hash-random key. Its leading hexadecimal digits deal every source into ranges of
keys, so that one source, however large, is sorted in many tasks; the ranges' token sums give each
range the number of tokens before it (a distributed prefix sum), and a running sum inside the range
gives each row its place. The mix takes whole epochs of a source while its target allows, then the
rows in key order up to the exact word at which the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskloom.llm.shared import WORD, saved, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source's target, and so a document's use, is at most this many times its size.
MAX_EPOCHS = 3
#: A source has 16**3 ranges of keys at least, and so many that one has some RANGE_ROWS rows at most.
RANGE_DIGITS, RANGE_ROWS = 3, 1 << 16


def _random_key(doc_id: Column, text: Column, seed: str) -> Column:
    """Of id and text, so that rows without an id, or with one id, lie apart."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def range_digits_of(n_rows: int) -> int:
    """Hexadecimal digits of the key that name a range, if all rows are of one source."""
    digits = RANGE_DIGITS
    while 16**digits * RANGE_ROWS < n_rows:
        digits += 1
    return digits


def source_targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of (skey, source, source_size), one row for each source.

    Weighted shares of all tokens, none above max_epochs times its source: the level is the highest
    of the shares that remain when the sources of smallest capacity for their weight are full.
    """
    at = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (at % len(weights) + 1).cast("int")).cast("double")
    rows = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    everything = W.partitionBy()
    before = W.orderBy(F.col("cap") / F.col("weight"), "skey").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    return (
        rows.withColumn("level", left / share)
        .withColumn("level", F.max("level").over(everything))
        .select("skey", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))
    )


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, range_digits: int | None = None, carry: bool = False) -> DataFrame:
    """One row for each row of docs(doc_id, source, text): doc_id, size, source_size, target, taken.

    carry adds the whole input row as the struct `row`. Null texts have size 0, a null source is a
    source of its own and the last one, null in doc_id and text is hashed as the empty string, rows
    with equal doc_id and text lie side by side, an empty table gives an empty result. Other columns
    of docs have no influence, nor has the number of ranges.
    """
    digits = range_digits or range_digits_of(docs.count())
    rows = docs.select(
        F.col("doc_id"),
        F.col("source"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("z")).alias("skey"),
        word_count(F.col("text")).alias("size"),
        _random_key(F.col("doc_id"), F.col("text"), seed).alias("key"),
        F.xxhash64("text").alias("tie"),
        *([F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if carry else []),
    ).withColumn("range", F.substring("key", 1, digits))
    if not carry:
        rows = saved(rows, "mix-sizes")
    ranges = saved(rows.groupBy("skey", "range").agg(F.first("source").alias("source"), F.sum("size").alias("range_size")), "mix-ranges")
    per_source = ranges.groupBy("skey").agg(F.first("source").alias("source"), F.sum("range_size").alias("source_size"))
    targets = source_targets(per_source, weights, max_epochs)
    so_far = W.partitionBy("skey").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    budgets = (
        ranges.join(targets, "skey")
        .withColumn("range_start", F.coalesce(F.sum("range_size").over(so_far), F.lit(0)))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")))
        .select("skey", "range", "source_size", "target", "range_start", "epochs", "budget")
    )
    place = W.partitionBy("skey", "range").orderBy("key", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("range_start") + F.coalesce(F.sum("size").over(place), F.lit(0))
    last = F.least(F.col("size"), F.greatest(F.lit(0), F.col("budget") - start))
    return (
        rows.join(budgets, ["skey", "range"])
        .withColumn("last", last)
        .select(
            "doc_id",
            F.col("size"),
            F.col("source_size"),
            F.col("target"),
            (F.col("epochs") * F.col("size") + F.col("last")).cast("long").alias("taken"),
            *([F.col("row")] if carry else []),
        )
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows that the mix is made of, with docs' columns: a document comes once for each time it is
    taken whole, and once more with its first words where the budget cuts it.

    Documents without words have no part in the mix of words and stay once, as they are.
    """
    rows = mix(docs, carry=True, **options)
    whole, part = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(whole + (part > 0).cast("long")).cast("int")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, part.cast("int")), "")
    out = rows.withColumn("times", times).filter("times > 0").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times"))))
    text = F.when((F.col("size") > 0) & (F.col("nth") > whole), cut).otherwise(F.col("row.text"))
    return out.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [1, 2, 3][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS lft,
              sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS shr
       FROM s1 WINDOW b AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT source, source_size, least(3 * source_size, weight * max(lft / shr) OVER ()) AS target FROM s2),
s4 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM s3),
r AS (SELECT d.doc_id, d.size, s4.source_size, s4.target, s4.epochs, floor(s4.target - s4.epochs * s4.source_size) AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(epochs * size + least(size, greatest(0, budget - start)) AS BIGINT) AS taken
FROM r
"""
