"""A store of mappings: a versioned table of (session, token, entity, term), which jobs add to and restore from.

A version holds the entries that no earlier one has, in a folder of its own; what is stored is the union of all up to a
version. A union has no order, so merging A and then B gives what B and then A gives. A token that has two
terms in a session is a conflict: both entries stay, flagged, and neither restores anything.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskloom.operators.masking import TOKEN_FORMAT, mapping_from_json, mapping_json
from maskloom.operators.sessions import restore_sessions

COLUMNS = ("session", "token", "entity", "term")


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def _entries(spark: SparkSession, path: str) -> DataFrame | None:
    """All entries with their version, or None before the first one."""
    return spark.read.parquet(path) if _exists(spark, f"{path}/version=1") else None


def upsert(mapping: DataFrame, path: str, session: str = "session", tries: int = 5) -> int:
    """Add the entries of mapping(session, token, entity, term) that are not there yet; the newest version then. Entries
    that are there already, repeated rows and a second run of one job add nothing, and without a new entry no
    version. Sessions are told by their text. Null sessions are one session, entries without a token are left out. Two jobs that write at
    once get versions of their own: the later one sees that its version is taken and looks again."""
    spark = mapping.sparkSession
    rows = mapping.select(F.col(session).cast("string").alias("session"), *COLUMNS[1:]).filter("token IS NOT NULL").distinct()
    for _ in range(tries):
        known = _entries(spark, path)
        version = (known.agg(F.max("version")).first()[0] or 0) if known is not None else 0
        if known is None:
            new = rows
        else:
            known = known.select(*(F.col(c).alias(f"__{c}") for c in COLUMNS))
            new = rows.join(known, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in COLUMNS], "left_anti")
        if new.isEmpty():
            return version
        try:
            new.repartition("session").write.parquet(f"{path}/version={version + 1}")
            return version + 1
        except AnalysisException:  # the folder is there by now
            continue
    raise RuntimeError(f"no free version of {path} in {tries} tries")


def stored(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """session, token, entity, term, conflict of a version, of the newest one without. A store that is not there is empty."""
    rows = _entries(spark, path)
    if rows is None:
        return spark.createDataFrame([], "session string, token string, entity string, term string, conflict boolean")
    rows = rows if version is None else rows.filter(F.col("version") <= version)
    rows = rows.select(*COLUMNS).distinct()  # a job that was run twice at once
    same, of = W.partitionBy("session", "token"), F.struct("entity", "term")
    return rows.withColumn("conflict", F.min(of).over(same) != F.max(of).over(same))


def restored(df: DataFrame, masked: str, session: str, path: str, version: int | None = None, token_format: str = TOKEN_FORMAT) -> DataFrame:
    """sessions.restore_sessions() with what is stored; tokens in conflict stay as they are."""
    mapping = stored(df.sparkSession, path, version).filter("NOT conflict")
    name = "__session_text"
    rows = df.withColumn(name, F.col(session).cast("string"))
    return restore_sessions(rows, masked, name, mapping.withColumnRenamed("session", name), token_format).drop(name)


def from_json_rows(df: DataFrame, session: str, text: str) -> DataFrame:
    """session, token, entity, term of serialised mappings, a row each; those that mapping_from_json() refuses have none."""
    return df.select(F.col(session).alias("session"), F.inline_outer(mapping_from_json(F.col(text))["entries"])).filter("token IS NOT NULL")


def to_json_rows(mapping: DataFrame, token_format: str = TOKEN_FORMAT, most: int = 10_000) -> DataFrame:
    """session, mapping: each session's entries serialised, by token, with the highest number of each entity; null for more
    than most entries, which no reader takes."""
    # without its name, which may hold digits, a token's first digits are its number
    number = F.regexp_extract(F.replace(F.col("token"), F.col("entity"), F.lit("")), "[0-9]+", 0).cast("int")
    top = mapping.groupBy("session", "entity").agg(F.max(number).alias("n"), F.count("*").alias("size"))
    tops = top.groupBy("session").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity", "n")))).alias("counters"), F.sum("size").alias("size"))
    # only what fits is gathered
    fits = tops.select(F.col("session").alias("__of"), "counters", (F.col("size") <= most).alias("__fits"))
    entry = F.when(F.col("__fits"), F.struct("token", "entity", "term"))
    rows = mapping.join(fits, F.col("session").eqNullSafe(F.col("__of"))).groupBy("session", "counters", "__fits").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    return rows.select("session", F.when(F.col("__fits"), mapping_json(F.col("entries"), F.col("counters"), token_format)).alias("mapping"))
