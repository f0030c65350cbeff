"""Server-sent events as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_events(streams: DataFrame, body: str) -> DataFrame:
    """streams with a row for each event: pos, event (null if not named) and data, its data lines joined."""
    others = [c for c in streams.columns if c != body]
    rows = streams.select(*others, F.posexplode(F.split(body, r"\r?\n\r?\n", -1)).alias("pos", "raw")).filter(F.col("raw").rlike(r"\S"))
    lines = F.split("raw", r"\r?\n", -1)
    values = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(f"{name}:")), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
    return rows.select(*others, "pos", F.get(values("event"), 0).alias("event"), F.array_join(values("data"), "\n").alias("data"))
