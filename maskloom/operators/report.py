"""Reports over masked texts: what was found, whether anything leaks, and whether restoring gives the text back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.regexlang import escaped
from maskloom.operators import guard, masking
from maskloom.sources.dictionary import Dictionary


def normalized_aliases(text: Column, dictionary: Dictionary) -> Column:
    """The text with aliases as the canonical names of their groups, the longest alias first. Aliases that begin with
    an ASCII letter or digit are replaced in any case."""
    pairs = sorted(((t.term, t.canonical) for t in dictionary.terms if t.term != t.canonical), key=lambda p: -len(p[0]))
    for alias, canonical in pairs:
        case = "(?iu)" if re.match("[A-Za-z0-9]", alias) else ""
        text = F.regexp_replace(text, case + escaped(alias), canonical.replace("\\", r"\\").replace("$", r"\$"))
    return text


def inspected(df: DataFrame, text: str, dictionary: Dictionary) -> DataFrame:
    """df with found (spans by start), masked, leak, leaks (rules by category), n_leaks and lossless: whether the
    restored text is the text with its aliases as canonical names, or the text itself, in any case."""
    rows = masking.find_spans(df, text, dictionary, "found")
    rows = masking.restore(masking.mask(rows, text, dictionary), "masked", "entries")
    rows = rows.withColumns({"leaks": guard.leaks(F.col("masked"), dictionary), "leak": guard.leak(F.col("masked"), dictionary)})
    same = lambda a, b: F.lower(F.coalesce(a, F.lit(""))) == F.lower(F.coalesce(b, F.lit("")))
    plain = normalized_aliases(F.col(text), dictionary)
    lossless = same(F.col("restored_text"), F.col(text)) | same(normalized_aliases(F.col("restored_text"), dictionary), plain)
    rows = rows.withColumns({"lossless": lossless, "n_leaks": leak_total(F.col("leaks"))})
    return rows.select(*df.columns, "found", "masked", "leak", "leaks", "n_leaks", "lossless")


def leak_total(leaks: Column) -> Column:
    """The rules that match, over all categories."""
    return F.aggregate(F.map_values(leaks), F.lit(0).cast("long"), lambda s, n: s + n)


def mapping_tokens(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["token"])


def restored_segments(masked: Column, entries: Column) -> Column:
    """array<struct<text, restored>>: the masked text cut at its known tokens, which are given back as their terms."""
    known = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["token"].alias("key"), e["term"].alias("value"))))
    parts = masking.segments(masked, mapping_tokens(entries))
    return F.transform(parts, lambda s: F.struct(F.when(s["is_token"], F.element_at(known, s["text"])).otherwise(s["text"]).alias("text"), s["is_token"].alias("restored")))


def bypassed_distinct(masked: DataFrame, *keys: str) -> DataFrame:
    """keys and surfaces: how many different surfaces were kept on purpose in masked(bypassed_surfaces, ...)."""
    rows = masked.select(*keys, F.explode("bypassed_surfaces").alias("surface"))
    return rows.groupBy(*keys).agg(F.count_distinct("surface").alias("surfaces"))


def status(events: DataFrame, dictionary: Dictionary, windows: DataFrame, now: Column) -> DataFrame:
    """One row: what is protected, whether a bypass window is open at `now` and until when, and the totals of
    events(masked map, guard_tripped boolean)."""
    terms = {"terms": len(dictionary.terms), "strict": sum(t.strict for t in dictionary.terms), "patterns": len(dictionary.patterns)}
    until = F.expr("from_ts + make_interval(0, 0, 0, 0, 0, minutes, 0)")
    open_now = windows.filter(F.col("minutes").between(1, 1440) & (F.col("from_ts") <= now) & (until > now)).agg(F.max(until).alias("bypass_until"))
    masked = F.aggregate(F.map_values("masked"), F.lit(0).cast("long"), lambda s, n: s + n)
    totals = events.agg(F.count("*").alias("events"), F.coalesce(F.sum(masked), F.lit(0)).alias("masked"), F.count_if("guard_tripped").alias("tripped"))
    rows = totals.crossJoin(open_now)  # one row each
    return rows.select(*(F.lit(n).cast("long").alias(name) for name, n in terms.items()), F.col("bypass_until").isNotNull().alias("bypassed"), "bypass_until", "events", "masked", "tripped")
