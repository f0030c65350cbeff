"""The thin queries op1_ to op13_ over the tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from maskloom.llm import bpe, decontamination, embeddings, gif, langid, lines, mixing, ngrams, phrases, pii, repair, secrets, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The installed vocabulary file with word ends."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_gif_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digest(_table(spark, sf_dir, "documents"))


def op7_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(_table(spark, sf_dir, "documents"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(_table(spark, sf_dir, "pages"))


def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(_table(spark, sf_dir, "conversations"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_language_id": op3_language_id,
        "op4_mix_sources": op4_mix_sources,
        "op5_embedding_tiles": op5_embedding_tiles,
        "op6_gif_columns": op6_gif_columns,
        "op7_pii_anchors": op7_pii_anchors,
        "op8_line_dedup": op8_line_dedup,
        "op9_warc_derivatives": op9_warc_derivatives,
        "op10_bpe_automaton": op10_bpe_automaton,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_phrase_mining": op12_phrase_mining,
        "op13_decontamination": op13_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard": ngrams.ORACLE_SQL,
        "op4_mix_sources": mixing.ORACLE_SQL,
        "op11_conversation_repair": repair.ORACLE_SQL,
        "op12_phrase_mining": phrases.ORACLE_SQL,
        "op13_decontamination": decontamination.ORACLE_SQL,
    }
