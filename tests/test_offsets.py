"""Units of offsets against Python's encoders."""

import random

import pytest
from pyspark.sql import functions as F

from maskloom.functions import offsets

PARTS = ["a", "é", "漢", "😀", "🏳️‍🌈", "\n", "𝒳", "ab", "한글"]


def _at(text, k, unit):
    return k if unit == "code_points" else len(text[:k].encode("utf-16-le")) // 2 if unit == "utf16" else len(text[:k].encode())


@pytest.mark.parametrize("unit", ["utf16", "bytes"])
def test_there_and_back(spark, unit):
    rng, rows = random.Random(3), []
    for k in range(200):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 30)))
        rows.append((k, text, [tuple(sorted(rng.choices(range(len(text) + 1), k=2))) for _ in range(rng.randint(0, 6))]))
    df = spark.createDataFrame(rows, "k long, t string, s array<struct<start:int,end:int>>")
    df = df.withColumn("u", offsets.converted(F.col("t"), F.col("s"), "code_points", unit)).withColumn("b", offsets.converted(F.col("t"), F.col("u"), unit, "code_points"))
    other = "bytes" if unit == "utf16" else "utf16"
    for r in df.withColumn("o", offsets.converted(F.col("t"), F.col("u"), unit, other)).collect():
        assert [tuple(x) for x in r.u] == [(_at(r.t, a, unit), _at(r.t, b, unit)) for a, b in r.s]
        assert [tuple(x) for x in r.b] == [tuple(x) for x in r.s]
        assert [tuple(x) for x in r.o] == [(_at(r.t, a, other), _at(r.t, b, other)) for a, b in r.s]


def test_inside_of_characters_and_edges(spark):
    rows = [("x😀é", [(2, 2), (1, 2), (0, 99), (-3, 1), None, (None, 1)]), (None, [(0, 1)]), ("abc", None), ("", [(0, 5)])]
    df = spark.createDataFrame(rows, "t string, s array<struct<start:int,end:int>>")
    got = [r.p for r in df.select(offsets.converted(F.col("t"), F.col("s"), "utf16", "code_points").alias("p")).collect()]
    assert [x and tuple(x) for x in got[0]] == [(1, 2), (1, 2), (0, 3), (0, 1), None, None]
    assert got[1:3] == [[], []] and tuple(got[3][0]) == (0, 0)
    got = df.limit(1).select(offsets.converted(F.col("t"), F.array(F.struct(F.lit(3).alias("start"), F.lit(6).alias("end"))), "bytes", "utf16").alias("p")).first().p
    assert tuple(got[0]) == (1, 4)
    with pytest.raises(ValueError):
        offsets.converted(F.col("t"), F.col("s"), "utf8", "bytes")
