"""Offsets of spans in code points, UTF-16 units and bytes of UTF-8, each way.

Spans of this library are in code points. Readers in other languages count UTF-16 units or bytes; what they need of a
text is only where its wide characters are: a running index of these turns an offset by one binary search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("code_points", "utf16", "bytes")
_PLACES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class WideCharacters:
    """The characters of a text that take more than one unit, by the places of their first units."""

    def __init__(self, text: bytes, unit: str):
        raw = np.frombuffer(text, np.uint8)
        # bytes that begin a character of four, three and two bytes; in UTF-16 only the first kind has two units
        least = 0xF0 if unit == "utf16" else 0xC0
        at = np.flatnonzero(raw >= least) if unit != "code_points" else np.zeros(0, np.int64)
        points = np.cumsum((raw & 0xC0) != 0x80) - 1 if len(at) else np.zeros(0, np.int64)
        self.n = int(np.count_nonzero((raw & 0xC0) != 0x80))
        self.points = points[at]
        lead = raw[at]
        extra = np.ones(len(at), np.int64) if unit == "utf16" else (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
        self.before = np.concatenate(([0], np.cumsum(extra)))  # units beyond one for each character, up to a wide one
        self.units = self.points + self.before[:-1]

    def from_points(self, offsets: np.ndarray) -> np.ndarray:
        return offsets + self.before[np.searchsorted(self.points, offsets)]

    def to_points(self, offsets: np.ndarray, up: bool) -> np.ndarray:
        """Offsets inside of a character are its begin, or its end if up."""
        k = np.searchsorted(self.units, offsets)  # wide characters that begin before
        last = np.maximum(k - 1, 0)
        if not len(self.units):
            return offsets
        width = self.before[last + 1] - self.before[last] + 1
        inside = (k > 0) & (offsets < self.units[last] + width)
        return np.where(inside, self.points[last] + (1 if up else 0), offsets - self.before[k])


def converted(text: Column, spans: Column, source: str, target: str) -> Column:
    """array<struct<start, end>>: the spans of a text, array<struct<start, end, ...>>, in another unit.

    An offset inside of a character widens its span to the whole character. Offsets beyond the text are its end, negative
    ones its begin. Null texts and null arrays have none; a null span, or one with a null end, is null.
    """
    if source not in UNITS or target not in UNITS:
        raise ValueError(f"units are {', '.join(UNITS)}")

    @F.arrow_udf("array<struct<start:bigint,end:bigint>>")
    def turned(texts: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for value, row in zip(texts.cast(pa.binary()), places, strict=True):
            given = row.as_py() if value.is_valid else None
            if not given:
                out.append([])
                continue
            there, back = WideCharacters(value.as_py(), target), WideCharacters(value.as_py(), source)
            good = [k for k, x in enumerate(given) if x is not None and x["start"] is not None and x["end"] is not None]
            sides = []
            for name, up in (("start", False), ("end", True)):
                points = back.to_points(np.array([max(given[k][name], 0) for k in good], np.int64), up)
                sides.append(there.from_points(np.minimum(points, there.n)).tolist())
            told = dict(zip(good, zip(*sides, strict=True), strict=True))
            out.append([{"start": told[k][0], "end": told[k][1]} if k in told else None for k in range(len(given))])
        return pa.array(out, _PLACES)

    pick = lambda x: F.when(x.isNotNull(), F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end")))
    return turned(text, F.transform(spans, pick))
