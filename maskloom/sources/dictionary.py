"""Term dictionaries: YAML to a checked Dictionary, and its relations.

A dictionary maps categories to entries. An entry is a list of aliases parted by commas, the first of
them canonical, or a map {term, boundary: strict, allow_short}; a category may also be a map
{terms, patterns}. The order of entries is part of the meaning, so every relation has `ord`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskloom.functions.regexlang import NESTED_REPETITION, translated

#: Limits of a dictionary.
CATEGORY = r"^[A-Z][A-Z0-9_]*$"
PATTERN_CHARS, PATTERNS, TERM_CHARS = 200, 50, 1024


class DictionaryError(ValueError):
    """A dictionary that can't be used."""


@dataclass(frozen=True)
class Term:
    ord: int
    entity: str
    term: str
    canonical: str
    strict: bool
    allow_short: bool
    suffix: str


@dataclass
class Dictionary:
    terms: list[Term] = field(default_factory=list)
    patterns: list[tuple[int, str, str]] = field(default_factory=list)  # ord, entity, pattern
    warnings: list[str] = field(default_factory=list)

    def terms_df(self, spark: SparkSession) -> DataFrame:
        rows = [(t.ord, t.entity, t.term, t.canonical, "strict" if t.strict else None, t.allow_short, t.suffix) for t in self.terms]
        return spark.createDataFrame(rows, "ord int, entity string, term string, canonical string, boundary string, allow_short boolean, token_suffix string")

    def patterns_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.patterns, "ord int, entity string, pattern string")


def letter_index(k: int) -> str:
    """0 to A, 25 to Z, 26 to AA."""
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def parse_dictionary(*contents: str) -> Dictionary:
    """One dictionary of one or more YAML texts, merged in their order; DictionaryError for what is not allowed."""
    import yaml

    out = Dictionary()
    seen: dict[str, tuple[str, str]] = {}  # term -> category, canonical
    groups: dict[tuple[str, str], int] = {}  # category, canonical -> group
    last: dict[str, int] = {}
    owners: dict[str, str] = {}
    for content in contents:
        data = yaml.safe_load(content) or {}
        if not isinstance(data, dict):
            raise DictionaryError("a dictionary maps categories to entries")
        for category, value in data.items():
            if not re.match(CATEGORY, str(category)):
                raise DictionaryError(f"category {category!r} is not in capital letters")
            value = value or []
            entries, patterns = (value.get("terms") or [], value.get("patterns") or []) if isinstance(value, dict) else (value, [])
            for p in patterns:
                _check_pattern(category, p)
                if p in owners:
                    out.warnings.append(f"pattern of {category} is that of {owners[p]}")
                    continue
                owners[p] = category
                out.patterns.append((len(out.patterns), category, p))
            for entry in entries:
                _add_entry(out, category, entry, seen, groups, last)
    if len(out.patterns) > PATTERNS:
        raise DictionaryError(f"more than {PATTERNS} patterns")
    return out


def _check_pattern(category: str, pattern: str) -> None:
    if len(pattern) > PATTERN_CHARS:
        raise DictionaryError(f"a pattern of {category} has more than {PATTERN_CHARS} characters")
    if re.search(NESTED_REPETITION, pattern):
        raise DictionaryError(f"a pattern of {category} repeats a repetition")
    if pattern.startswith("(?i"):
        raise DictionaryError(f"a pattern of {category} has an inline flag")
    try:
        if re.compile(translated(pattern, java=False), re.ASCII).match(""):
            raise DictionaryError(f"a pattern of {category} matches the empty text")
    except re.error as e:
        raise DictionaryError(f"a pattern of {category}: {e}") from e


def _add_entry(out, category, entry, seen, groups, last) -> None:
    options = entry if isinstance(entry, dict) else {"term": entry}
    aliases = [a.strip() for a in str(options.get("term", "")).split(",") if a.strip()]
    if not aliases:
        raise DictionaryError(f"an empty term in {category}")
    canonical = aliases[0]
    group = groups.get((category, canonical))
    if group is None:
        group = groups[category, canonical] = last[category] = last.get(category, 0) + 1
    for k, alias in enumerate(aliases):
        if re.search(r"[\x00-\x1f\x7f]", alias):
            raise DictionaryError(f"a control character in a term of {category}")
        if len(alias.encode("utf-16-le")) == 2 and not options.get("allow_short"):
            raise DictionaryError(f"a term of one character in {category}")
        if alias in seen:
            if seen[alias][0] != category:
                raise DictionaryError(f"a term of {category} is one of {seen[alias][0]} too")
            if seen[alias][1] != canonical:
                raise DictionaryError(f"a term of {category} is in two groups")
            continue
        if alias == category:
            out.warnings.append(f"a term of {category} is its name; its own tokens would be found")
        seen[alias] = category, canonical
        out.terms.append(Term(len(out.terms), category, alias, canonical, options.get("boundary") == "strict", bool(options.get("allow_short")), f"{group}{letter_index(k)}"))


def load_dictionary(spark: SparkSession, path: str) -> Dictionary:
    """A YAML file, or all *.yaml and *.yml of a folder in the order of their names, from any store that Spark reads."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name()).filter(F.col("path").rlike(r"\.ya?ml$")).orderBy("path").collect()
    if not files:
        raise DictionaryError(f"no dictionary at {path}")
    return parse_dictionary(*(r.value for r in files))


def commented_terms(files: DataFrame) -> DataFrame:
    """(name, category, commented) of files(name, content): items that are commented out, by the category above."""
    lines = files.select("name", F.posexplode(F.split("content", r"\r?\n", -1)).alias("pos", "line"))
    head = F.nullif(F.regexp_extract("line", r"^([A-Z][A-Z0-9_]*):", 1), F.lit(""))
    above = W.partitionBy("name").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("category", F.last(head, ignorenulls=True).over(above)).filter(r"category IS NOT NULL AND line RLIKE '^\\s*#\\s*-\\s+\\S'")
    return rows.groupBy("name", "category").agg(F.count("*").alias("commented"))


def alias_groups(entries: DataFrame) -> DataFrame:
    """(category, ord, alias_no, alias, group_no, token_suffix) of entries(category, ord, entry): aliases of a line
    share the group of its first one; groups are numbered by first appearance."""
    from maskloom.functions.text import letters

    rows = entries.withColumn("aliases", F.filter(F.transform(F.split("entry", ","), lambda x: F.trim(x)), lambda x: x != "")).withColumn("canonical", F.get("aliases", 0))
    rows = rows.withColumn("at", F.min("ord").over(W.partitionBy("category", "canonical")))
    rows = rows.withColumn("group_no", F.dense_rank().over(W.partitionBy("category").orderBy("at")))
    rows = rows.select("category", "ord", "group_no", F.posexplode("aliases").alias("alias_no", "alias"))
    return rows.withColumn("token_suffix", F.concat(F.col("group_no").cast("string"), letters(F.col("alias_no"))))


def lint(entries: DataFrame) -> DataFrame:
    """entries(category, ord, entry, allow_short) with problem: the first rule that an entry breaks, or ok."""
    aliases = F.filter(F.transform(F.split("entry", ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = entries.withColumn("aliases", aliases)
    owners = rows.select("category", F.explode("aliases").alias("alias")).groupBy("alias").agg(F.count_distinct("category").alias("n")).filter("n > 1")
    crossed = rows.select("ord", F.explode("aliases").alias("alias")).join(owners, "alias").select(F.col("ord").alias("crossed")).distinct()
    problem = (
        F.when(~F.col("category").rlike(CATEGORY), "category name")
        .when(F.size("aliases") == 0, "empty")
        .when(F.col("entry").rlike(r"[\x00-\x1f\x7f]"), "control character")
        .when(F.exists("aliases", lambda a: F.length(F.encode(a, "UTF-16BE")) == 2) & ~F.coalesce("allow_short", F.lit(False)), "one character")
        .when(F.exists("aliases", lambda a: F.length(a) > TERM_CHARS), "too long")
        .when(F.col("crossed").isNotNull(), "two categories")
        .otherwise("ok")
    )
    return rows.join(crossed, F.col("ord") == F.col("crossed"), "left").select("category", "ord", "entry", problem.alias("problem"))


def summary(spark: SparkSession, dictionary: Dictionary) -> DataFrame:
    """category, terms, strict, patterns: one row for each category."""
    terms = dictionary.terms_df(spark).groupBy("entity").agg(F.count("*").alias("terms"), F.count_if(F.col("boundary") == "strict").alias("strict"))
    patterns = dictionary.patterns_df(spark).groupBy("entity").agg(F.count("*").alias("patterns"))
    rows = terms.join(patterns, "entity", "full")
    return rows.select(F.col("entity").alias("category"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("terms", "strict", "patterns")))
