"""The leak check: rules compiled apart from those of the masking, over its output."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.automaton import Spelling, TermFinder
from maskloom.functions.parts import by_parts
from maskloom.functions.regexlang import term_pattern, translated
from maskloom.functions.text import GUARD_INVISIBLE
from maskloom.operators.masking import needed_character
from maskloom.sources.dictionary import Dictionary

#: The parts of a request that the check covers.
GUARDED_KEYS = ("messages", "system", "prompt", "input")


class _Rules:
    """The rules for single texts. An automaton names the terms that may be in a text, whatever their case and number;
    each of these is then looked for by its own expression, as every pattern is. A worker compiles what it needs once."""

    _built: ClassVar[dict[str, tuple]] = {}

    def __init__(self, dictionary: Dictionary):
        terms = [t for t in dictionary.terms if t.term.strip()]
        self.rules = [(t.entity, term_pattern(t.term, t.strict, any_case=bool(re.match("[A-Za-z0-9]", t.term.strip())))) for t in terms]
        self.terms = [t.term for t in terms]
        self.patterns = [(entity, translated(p, java=False)) for _, entity, p in dictionary.patterns]
        self.key = hashlib.sha256(repr((self.rules, self.patterns)).encode()).hexdigest()

    def tripped(self, text: str) -> Iterator[str]:
        """The category of each rule that matches."""
        if self.key not in self._built:
            if len(self._built) >= 4:
                self._built.clear()
            self._built[self.key] = TermFinder([Spelling(t) for t in self.terms]), {}, [(entity, re.compile(p, re.ASCII), needed_character(p)) for entity, p in self.patterns]
        finder, compiled, patterns = self._built[self.key]
        for k in finder.present(text):
            if k not in compiled:
                if len(compiled) >= 10_000:
                    compiled.clear()
                compiled[k] = re.compile(self.rules[k][1], re.ASCII)
            if compiled[k].search(text):
                yield self.rules[k][0]
        for entity, pattern, needed in patterns:
            if needed in text and pattern.search(text):
                yield entity


def leaks(text: Column, dictionary: Dictionary) -> Column:
    """category -> number of its rules that match, for those that have any; an empty map for null. The plan doesn't grow
    with the rules."""
    rules = _Rules(dictionary)

    @F.arrow_udf("map<string,bigint>")
    @by_parts
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array([list(Counter(rules.tripped(t or "")).items()) for t in texts.to_pylist()], pa.map_(pa.string(), pa.int64()))

    return counted(text)


def leak(text: Column, dictionary: Dictionary) -> Column:
    """Whether any rule matches the text without its invisible characters: one search for all terms. False for null."""
    rules = _Rules(dictionary)

    @F.arrow_udf("boolean")
    @by_parts
    def any_tripped(texts: pa.Array) -> pa.Array:
        return pa.array([next(rules.tripped(t or ""), None) is not None for t in texts.to_pylist()], pa.bool_())

    return any_tripped(F.regexp_replace(text, GUARD_INVISIBLE, ""))


def without_bypassed(text: Column, surfaces: Column) -> Column:
    """The text without any of the surfaces that were kept on purpose."""
    return F.aggregate(surfaces, text, lambda t, s: F.replace(t, s, F.lit("")))


def guarded(df: DataFrame, masked: str, dictionary: Dictionary, bypassed: str | None = None, mode: str = "withhold") -> DataFrame:
    """df with leak. bypassed: the column of the surfaces that were kept on purpose, which are no leak. mode withhold:
    masked is null where there is a leak, so a check that trips lets nothing through; raise: the job fails at the
    first one; off: nothing is looked for, leak is false."""
    if mode not in ("withhold", "raise", "off"):
        raise ValueError(f"no mode {mode}")
    if mode == "off":
        return df.withColumn("leak", F.lit(False))
    scope = F.col(masked) if bypassed is None else without_bypassed(F.col(masked), F.col(bypassed))
    df = df.withColumn("leak", leak(scope, dictionary))
    if mode == "raise":
        return df.withColumn("leak", F.when(F.col("leak"), F.raise_error(F.lit("a protected term is left in a masked text")).cast("boolean")).otherwise(F.lit(False)))
    return df.withColumn(masked, F.when(~F.col("leak"), F.col(masked)))
