"""A corpus from documents: language, lines, near duplicates, mixture, tokens.

Every stage takes null and empty texts, repeated rows, null ids and further columns, and an empty table gives
an empty one; what becomes of such rows is told with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskloom.llm import bpe, langid, lines, mixing, ngrams
from maskloom.llm.queries import tokenizer_path
from maskloom.llm.shared import forget, saved


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is predicted and not rejected. Null and empty texts and texts without a letter have
    none and go; without a labelled row nothing can be told and all rows go."""
    return langid.accepted(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line repeats, exactly or nearly. A document that keeps no word
    goes; n_chars is that of the new text."""
    kept = lines.deduplicated(docs).filter(r"n_removed = 0 OR text RLIKE '[^ \\t-\\r]'")
    return kept.withColumn("n_chars", lines.F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Texts without words and rows
    without an id stay."""
    return ngrams.kept_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or their first words, as often as the mixture takes them. Texts without words stay once; a null
    source is a source of its own."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token_ids and the text decoded from them; null and empty texts have no tokens."""
    return bpe.tokenize(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixture", mix_sources),
    ("tokens", encode_tokens),
]

#: Training, hashing and union-find can't be said in SQL; tests/llm hold the stages against plain computations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; every other stage's rows are written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        written = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            forget(before)
        docs = before = written
    return STAGES[-1][1](spark, docs, sf_dir)
