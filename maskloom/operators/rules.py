"""The leak check with rules in a table: an inverted index of rules, joined with the texts.

A rule is a term, of which there may be millions. A text can only hold a term if it holds all of the term's grams,
so each rule is filed under one of them, the one that the fewest texts have. Texts meet a rule only where they
share its gram; each such pair is then checked by the rule's own expression. Grams are GRAM characters of the folded
text (one case, one space between words), a shorter term is one gram.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.functions.automaton import Folded
from maskloom.functions.parts import by_parts
from maskloom.functions.regexlang import term_pattern
from maskloom.sources.written import forget, saved

GRAM = 4
#: A table of at most so many grams is broadcast.
BROADCAST_ROWS = 500_000


def _grams(text: str, sizes: tuple[int, ...]) -> set[str]:
    folded = Folded(text).text
    return {folded[k : k + n] for n in sizes for k in range(len(folded) - n + 1)}


@F.arrow_udf(T.ArrayType(T.StringType()))
def _of_terms(terms: pa.Array) -> pa.Array:
    """The grams of terms; blank ones have none."""
    out = []
    for term in terms.to_pylist():
        folded = Folded((term or "").strip()).text
        out.append(sorted(_grams(folded, (min(GRAM, len(folded)),))) if folded else [])
    return pa.array(out, pa.list_(pa.string()))


def _of_texts(sizes: tuple[int, ...]):
    @F.arrow_udf(T.ArrayType(T.StringType()))
    @by_parts
    def grams(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(_grams(t or "", sizes)) for t in texts.to_pylist()], pa.list_(pa.string()))

    return grams


@lru_cache(maxsize=10_000)
def _pattern(term: str, strict: bool) -> re.Pattern:
    return re.compile(term_pattern(term, strict, any_case=bool(re.match("[A-Za-z0-9]", term.strip()))), re.ASCII)


@F.arrow_udf(T.ArrayType(T.LongType()))
@by_parts
def _matching(texts: pa.Array, candidates: pa.Array) -> pa.Array:
    """The places of the candidates that match."""
    out = []
    for text, row in zip(texts.to_pylist(), candidates, strict=True):
        out.append([k for k, c in enumerate(row.as_py() or ()) if _pattern(c["term"], c["strict"]).search(text)])
    return pa.array(out, pa.list_(pa.int64()))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def rule_hits(texts: DataFrame, text: str, rules: DataFrame) -> DataFrame:
    """The columns of texts but text, with rule, category: a row for each rule of rules(rule, category, term, strict)
    that matches a row's text, by the same meaning as guard.leaks(): a term in any case if it begins with an ASCII letter or
    digit, else as it is written, with any white space between its words, not inside of an ASCII word and, if
    strict, not behind a Hangul or CJK character.

    Null texts and blank terms match nothing; a null strict is false. Rows that are equal are told apart; rules that are
    equal are one rule. Columns rule and category of texts are replaced. A gram of very many texts doesn't gather
    them: the index is broadcast where it is small, else Spark splits the texts of a gram.
    """
    keys = [c for c in texts.columns if c not in (text, "rule", "category")]
    named = saved(rules.select("rule", "category", "term", F.coalesce("strict", F.lit(False)).alias("strict")).distinct().withColumn("grams", _of_terms("term")), "rules")
    wanted = named.select(F.explode("grams").alias("gram")).distinct()
    sizes = tuple(r[0] for r in wanted.select(F.length("gram")).distinct().collect())  # GRAM of them at most
    rows = saved(texts.select(*keys, F.col(text).alias("__text")).withColumn("__row", F.monotonically_increasing_id()), "rule-texts")
    held = saved(rows.select("__row", F.explode(_of_texts(sizes)("__text")).alias("gram")).join(_small(wanted), "gram", "left_semi"), "rule-grams")
    # how many texts have a gram; a rule with a gram that none has matches nothing
    spread = held.groupBy("gram").agg(F.count("*").alias("n"))
    filed = named.select("rule", "category", "term", "strict", F.size("grams").alias("of"), F.explode("grams").alias("gram")).join(spread, "gram")
    filed = filed.groupBy("rule", "category", "term", "strict", "of").agg(F.count("*").alias("there"), F.min(F.struct("n", "gram")).alias("least"))
    filed = saved(filed.filter("there = of").select("rule", "category", "term", "strict", "least.gram"), "rule-index")
    pairs = held.join(_small(filed), "gram")
    # of a row: the rules that share their rarest gram with it
    by_row = pairs.groupBy("__row").agg(F.collect_list(F.struct("rule", "category", "term", "strict")).alias("__rules"))
    checked = rows.join(by_row, "__row").withColumn("__hits", _matching("__text", F.transform("__rules", lambda r: F.struct(r["term"].alias("term"), r["strict"].alias("strict")))))
    hit = F.explode(F.transform("__hits", lambda k: F.get("__rules", k.cast("int")))).alias("__hit")
    out = saved(checked.select(*keys, hit).select(*keys, F.col("__hit.rule").alias("rule"), F.col("__hit.category").alias("category")), "rule-hits")
    forget(named, rows, held, filed)
    return out


def rule_counts(hits: DataFrame, *keys: str) -> DataFrame:
    """keys, category, rules: how many rules of a category match."""
    return hits.groupBy(*keys, "category").agg(F.count("*").alias("rules"))
