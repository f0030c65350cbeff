"""Searching the text files below a folder for patterns, with the place of each hit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.operators import matchers

# Endings of files that are searched.
ENDINGS = ("js", "mjs", "css", "html", "json", "yaml", "yml", "md", "svg", "map")


def text_files(spark: SparkSession, folder: str, endings: tuple[str, ...] = ENDINGS, most_bytes: int | None = None) -> DataFrame:
    """path and text of the files below a folder; endings and size are left to the file source, which reads no other file.
    What is no UTF-8 becomes U+FFFD."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{%s}" % ",".join(endings)).load(folder)
    if most_bytes is not None:
        files = files.filter(F.col("length") <= most_bytes)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def scan(files: DataFrame, patterns: dict[str, str], allowed: dict[str, str] | None = None) -> DataFrame:
    """(path, name, found, line, column) for each hit of a named pattern in files(path, text), line by line, so no hit
    goes over a line's end; line and column begin at 1, columns count code points. allowed: of a name, what hits
    may begin with."""
    lines = files.select("path", F.posexplode(F.split("text", r"\r?\n", -1)).alias("line", "said"))
    hits = F.concat(*(matchers.of_pattern(name, p)(F.col("said")) for name, p in patterns.items()))
    found = lines.select("path", (F.col("line") + 1).alias("line"), F.inline_outer(hits)).filter("surface IS NOT NULL")
    for name, start in (allowed or {}).items():
        found = found.filter((F.col("entity") != name) | ~F.col("surface").rlike(f"^(?:{start})"))
    return found.select("path", F.col("entity").alias("name"), F.col("surface").alias("found"), "line", (F.col("start") + 1).alias("column"))
