"""Masking the strings of typed rows: a nested schema is compiled to expressions that take its strings out and put
masked ones back, by the field rules of jsonwalk. No JSON text is made or read.

The strings of a row, depth first in the order of the fields, are one session, as those of a JSON request are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.operators import jsonwalk, masking
from maskloom.sources.dictionary import Dictionary

_NONE = "array<string>"
#: Running sums are built in blocks of this many values.
BLOCK = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda n, x: n + x)


def sums_before(counts: Column) -> Column:
    """For each value of an array the sum of those before it."""

    def in_blocks(values: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(BLOCK)), lambda k: F.slice(values, k, BLOCK))
        return _let(blocks, lambda b: _let(F.transform(b, _sum), lambda totals: F.flatten(F.zip_with(b, _running(totals), lambda block, n: F.transform(_running(block), lambda x: x + n)))))

    return _let(counts, in_blocks)


def _running(values: Column) -> Column:
    return F.transform(values, lambda _, i: _sum(F.slice(values, F.lit(1), i)))


class _Walk:
    """Expressions over one schema. A string has a slot, a null one too, so what has no list or map in it has as many
    slots in each row."""

    def __init__(self, dialect: str):
        self.dialect = dialect

    def taken(self, kind: T.DataType, path: list) -> bool:
        """If a value at path may have a string that is masked."""
        rule = jsonwalk.field_rule(self.dialect, path) if path else "tokenize"
        if rule == "skip":
            return False
        if isinstance(kind, T.StringType):
            if rule == "json-string":
                raise ValueError(f"{path}: JSON in a string has no type; give it as a struct, or use jsonwalk.mask_requests()")
            return True
        if isinstance(kind, T.VariantType):
            raise ValueError(f"{path}: a variant has no schema; cast it to a type first")
        if isinstance(kind, T.StructType):
            return any([self.taken(f.dataType, [*path, f.name]) for f in kind.fields])
        if isinstance(kind, T.ArrayType):
            return self.taken(kind.elementType, [*path, 0])
        return isinstance(kind, T.MapType) and self.taken(kind.valueType, [*path, 0])

    def skipped(self, key: Column, path: list) -> Column:
        """jsonwalk.field_rule() of a map's key."""
        anthropic = self.dialect == "anthropic"
        fixed = jsonwalk.ANTHROPIC_SKIPPED if anthropic else jsonwalk.OPENAI_SKIPPED
        skip = key.endswith("_id") | key.isin(*fixed)
        if anthropic:
            return skip | (key == "data") if path[-1:] == ["source"] else skip
        text = F.raise_error(F.lit("JSON in a string has no type: arguments in a map")).cast("boolean")
        return F.when(key == "arguments", text).otherwise(skip)

    def strings(self, kind: T.DataType, value: Column, path: list) -> Column:
        """The slots of a value for which taken() holds."""
        nothing = F.array().cast(_NONE)
        if isinstance(kind, T.StringType):
            return F.array(value)
        if isinstance(kind, T.StructType):
            return F.concat(*(self.strings(f.dataType, value.getField(f.name), [*path, f.name]) for f in self.fields(kind, path)))
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.flatten(F.transform(value, lambda x: self.strings(kind.elementType, x, [*path, 0]))), nothing)
        one = lambda e: F.when(self.skipped(e["key"], path), nothing).otherwise(self.strings(kind.valueType, e["value"], [*path, 0]))
        return F.coalesce(F.flatten(F.transform(F.map_entries(value), one)), nothing)

    def fields(self, kind: T.StructType, path: list) -> list[T.StructField]:
        return [f for f in kind.fields if self.taken(f.dataType, [*path, f.name])]

    def count(self, kind: T.DataType, value: Column, path: list) -> int | Column:
        """The number of slots; an int if it is that of every row."""
        if isinstance(kind, T.StringType):
            return 1
        if isinstance(kind, T.StructType):
            total: int | Column = 0
            for f in self.fields(kind, path):
                n = self.count(f.dataType, value.getField(f.name), [*path, f.name])
                total = total + n if isinstance(n, int) or not isinstance(total, int) else n + total
            return total
        if isinstance(kind, T.ArrayType) and isinstance(n := self.count(kind.elementType, F.lit(None), [*path, 0]), int):
            return F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)) * n
        return F.coalesce(_sum(self.counts(kind, value, path)), F.lit(0))

    def counts(self, kind: T.ArrayType | T.MapType, value: Column, path: list) -> Column:
        """The number of slots of each element or entry."""
        number = lambda k, x: F.lit(n) if isinstance(n := self.count(k, x, [*path, 0]), int) else n
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: number(kind.elementType, x))
        return F.transform(F.map_entries(value), lambda e: F.when(self.skipped(e["key"], path), F.lit(0)).otherwise(number(kind.valueType, e["value"])))

    def rebuilt(self, kind: T.DataType, value: Column, path: list, slots: Column, at: Column) -> Column:
        """The value with the strings of slots from `at` on; what is null stays null."""
        if isinstance(kind, T.StringType):
            return F.get(slots, at)
        if isinstance(kind, T.StructType):
            parts = []
            for f in kind.fields:
                part, below = value.getField(f.name), [*path, f.name]
                if self.taken(f.dataType, below):
                    parts.append(self.rebuilt(f.dataType, part, below, slots, at).alias(f.name))
                    at = at + self.count(f.dataType, part, below)
                else:
                    parts.append(part.alias(f.name))
            return F.when(value.isNotNull(), F.struct(*parts))
        if isinstance(kind, T.ArrayType):
            element, below = kind.elementType, [*path, 0]
            n = self.count(element, F.lit(None), below)
            if isinstance(n, int):
                return _let(at, lambda a: F.transform(value, lambda x, i: self.rebuilt(element, x, below, slots, a + i * n)))
            return self._placed(value, self.counts(kind, value, path), at, lambda x, n: self.rebuilt(element, x, below, slots, n))

        def entry(e: Column, n: Column) -> Column:
            masked = self.rebuilt(kind.valueType, e["value"], [*path, 0], slots, n)
            return F.struct(e["key"].alias("key"), F.when(self.skipped(e["key"], path), e["value"]).otherwise(masked).alias("value"))

        return F.map_from_entries(self._placed(F.map_entries(value), self.counts(kind, value, path), at, entry))

    @staticmethod
    def _placed(values: Column, counts: Column, at: Column, change: Callable[[Column, Column], Column]) -> Column:
        """change(value, its first slot) for each value."""
        return _let(at, lambda a: _let(sums_before(counts), lambda before: F.transform(values, lambda x, i: change(x, a + F.get(before, i)))))


def _root(df: DataFrame, columns: tuple[str, ...]) -> tuple[T.StructType, Column]:
    names = columns or tuple(df.columns)
    kind = T.StructType([df.schema[c] for c in names])
    return kind, F.struct(*(F.col(f"`{c}`") for c in names))


def typed_strings(df: DataFrame, *columns: str, dialect: str = "openai") -> Column:
    """array<string>: the strings of the columns that the rules of the dialect mask; all columns if none is named."""
    kind, value = _root(df, columns)
    walk = _Walk(dialect)
    return walk.strings(kind, value, []) if walk.taken(kind, []) else F.array().cast(_NONE)


def with_typed_strings(df: DataFrame, slots: str, *columns: str, dialect: str = "openai") -> DataFrame:
    """df with the strings of the array column slots in place of typed_strings()."""
    kind, value = _root(df, columns)
    walk = _Walk(dialect)
    if not walk.taken(kind, []):
        return df
    parts, at, new = walk.fields(kind, []), F.lit(0), {}
    for f in parts:
        new[f.name] = walk.rebuilt(f.dataType, value.getField(f.name), [f.name], F.col(slots), at)
        at = at + walk.count(f.dataType, value.getField(f.name), [f.name])
    return df.withColumns(new)


def _changed(df: DataFrame, columns: tuple[str, ...], dialect: str, change: Callable[[DataFrame], DataFrame], result: str) -> DataFrame:
    names = columns or tuple(df.columns)
    rows = change(df.withColumn("__strings", typed_strings(df, *names, dialect=dialect)))
    # rows as they are, apart from what follows: Spark can't plan a later Python function over this one and nested lambdas
    rows = rows.mapInArrow(lambda batches: batches, rows.schema)
    return with_typed_strings(rows, result, *names, dialect=dialect).drop("__strings", result)


def mask_typed(df: DataFrame, dictionary: Dictionary, *columns: str, dialect: str = "openai") -> DataFrame:
    """df with its columns masked, and with entries, max_group, hits, bypassed and bypassed_surfaces. A row is one session.
    Null strings, structs, lists and maps stay; keys of maps and binary values are not masked. A column of a result's name is
    refused, as are JSON texts in strings (arguments) and variants, whose strings would stay as they are."""
    clash = set(df.columns) & {"masked", "entries", "max_group", "hits", "bypassed", "bypassed_surfaces"}
    if clash:
        raise ValueError(f"columns that the result has too: {sorted(clash)}")
    return _changed(df, columns, dialect, lambda rows: masking.mask_strings(rows, "__strings", dictionary), "masked")


def restore_typed(df: DataFrame, entries: str, *columns: str, dialect: str = "openai") -> DataFrame:
    """df with the known tokens in its columns as their terms, and with restored, their number. All columns but entries
    if none is named."""
    names = columns or tuple(c for c in df.columns if c != entries)
    return _changed(df, names, dialect, lambda rows: masking.restore_strings(rows, "__strings", entries), "restored_text")
