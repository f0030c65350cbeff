"""Finding, masking and restoring dictionary terms.

One Arrow function cleans a text, finds all terms by one automaton and each pattern in one
pass, resolves overlaps and numbers the terms, in time that is linear in a text's hits and doesn't grow with the
number of terms. Nothing is shuffled, since a document is a session of its own; a row may also hold several strings
that are one session. sessions.py has sessions of many rows.
"""

from __future__ import annotations

import hashlib
import re
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.automaton import Spelling, TermFinder
from maskloom.functions.parts import by_parts
from maskloom.functions.regexlang import SPACE, translated
from maskloom.functions.text import INVISIBLE, LOOK_ALIKE, TOKEN
from maskloom.sources.dictionary import TERM_CHARS, Dictionary

TOKEN_FORMAT = "<{type}_{n}>"
SPAN = "struct<start:int,end:int,entity:string,surface:string,suffix:string>"
_ENTRY = "struct<token:string,entity:string,term:string>"
_MASKED = f"struct<masked:array<string>,entries:array<{_ENTRY}>,max_group:map<string,int>,hits:map<string,int>,bypassed:map<string,int>,bypassed_surfaces:array<string>>"
_SPACES = re.compile(f"[{SPACE}]+")
_INVISIBLE, _LOOK_ALIKE = re.compile(INVISIBLE), re.compile(LOOK_ALIKE)
_DOUBLE = re.compile(rf"<({TOKEN})>")


def term_key(surface: Column) -> Column:
    """Of a found term: lower case, one space between words."""
    return F.lower(F.regexp_replace(surface, f"[{SPACE}]+", " "))


class Finder:
    """Leftmost longest spans of terms and patterns in single texts. It travels as its dictionary; a worker builds
    the automaton of the terms once."""

    _built: ClassVar[dict[str, tuple]] = {}

    def __init__(self, dictionary: Dictionary):
        usable = [t for t in dictionary.terms if t.term.strip() and len(t.term) <= TERM_CHARS]
        self.terms = sorted(usable, key=lambda t: -len(t.term))
        self.patterns = [(entity, translated(p, java=False)) for _, entity, p in dictionary.patterns]
        self.key = hashlib.sha256(repr((self.terms, self.patterns)).encode()).hexdigest()

    def _rules(self) -> tuple[TermFinder, list[tuple[str, re.Pattern, str]]]:
        if self.key not in self._built:
            if len(self._built) >= 4:  # of some dictionaries at most
                self._built.clear()
            patterns = [(entity, re.compile(p, re.ASCII), needed_character(p)) for entity, p in self.patterns]
            self._built[self.key] = TermFinder([Spelling(t.term, t.strict) for t in self.terms]), patterns
        return self._built[self.key]

    def __call__(self, text: str | None) -> list[tuple]:
        """(start, end, entity, surface, suffix), none inside of another one. Where start and length are equal terms go
        before patterns, and patterns by their order."""
        if not text:
            return []
        terms, patterns = self._rules()
        every = [(start, -end, 0, self.terms[k].entity, self.terms[k].suffix) for start, end, k in terms.leftmost(text)]
        for rank, (entity, pattern, needed) in enumerate(patterns, 1):
            if needed in text:
                every += ((m.start(), -m.end(), rank, entity, None) for m in pattern.finditer(text))
        every.sort(key=lambda x: x[:3])
        out, reach = [], 0
        for start, end, _, entity, suffix in every:
            if start >= reach:
                reach = -end
                out.append((start, reach, entity, text[start:reach], suffix))
        return out


def needed_character(pattern: str) -> str:
    """A character that each match has, the rarest by a rough order, or the empty text if none is known."""
    found = [chr(c) for op, c in re._parser.parse(pattern, re.ASCII) if op == re._constants.LITERAL]
    return min(found, key=lambda c: (c in "etaoinshr .,", c.isalnum(), c), default="")


def may_hold_terms(text: Column, dictionary: Dictionary) -> Column:
    """A cheap test that a text fails only if no term can be in it: it is shorter than each, or it has no ASCII letter
    or digit where each has one."""
    terms = [_SPACES.sub(" ", t.term.strip()) for t in dictionary.terms if t.term.strip()]
    long_enough = F.length(text) >= min(map(len, terms), default=1)
    plain = all(re.fullmatch(r"[A-Za-z0-9\s_-]+", t, re.ASCII) and re.search("[A-Za-z0-9]", t) for t in terms)
    return long_enough & text.rlike("[A-Za-z0-9]") if plain else long_enough


def find_spans(df: DataFrame, text: str, dictionary: Dictionary, out: str = "spans") -> DataFrame:
    """df with the array column out: leftmost longest spans of terms and patterns that don't overlap. Terms go
    before patterns, and patterns by their order, where start and length are equal. Null texts have none."""
    find, names = Finder(dictionary), ("start", "end", "entity", "surface", "suffix")

    @F.arrow_udf(f"array<{SPAN}>")
    @by_parts
    def spans(text: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(names, x, strict=True)) for x in find(t)] for t in text.to_pylist()], _SPANS_ARROW)

    return df.withColumn(out, spans(F.col(text)))


_ENTITY_COUNTS = pa.map_(pa.string(), pa.int32())
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity", pa.string()), ("surface", pa.string()), ("suffix", pa.string())]))
_MASKED_ARROW = pa.struct(
    [
        ("masked", pa.list_(pa.string())),
        ("entries", pa.list_(pa.struct([("token", pa.string()), ("entity", pa.string()), ("term", pa.string())]))),
        *((name, _ENTITY_COUNTS) for name in ("max_group", "hits", "bypassed")),
        ("bypassed_surfaces", pa.list_(pa.string())),
    ]
)


def spans_relation(df: DataFrame, *keys: str, spans: str = "spans") -> DataFrame:
    """A row (keys, start, end, entity, surface, ...) for each span. The outer form with a filter behind it: the
    inner form would be given a filter over the spans, which would find them twice."""
    return df.select(*keys, F.inline_outer(spans)).filter("surface IS NOT NULL")


def rendered(entity: str, number: str, token_format: str = TOKEN_FORMAT) -> str:
    return token_format.replace("{type}", entity, 1).replace("{n}", number, 1)


def token_pattern(token_format: str = TOKEN_FORMAT) -> re.Pattern:
    """What tokens of a format look like."""
    before, _, rest = token_format.partition("{type}")
    middle, _, after = rest.partition("{n}")
    return re.compile(f"{re.escape(before)}[A-Z][A-Z0-9_]*{re.escape(middle)}[0-9]+[A-Z]*{re.escape(after)}")


class _Session:
    """Tokens of one session. A term has one token, whatever its case. A token that another surface has already gives
    way to the entity's next free number. A text may hold tokens that the session has given: they stay as they are."""

    def __init__(self, token_format: str, escape: bool):
        self.token_format, self.escape = token_format, escape
        self.by_key: dict[tuple[str, str], str] = {}
        self.by_token: dict[str, tuple[str, str]] = {}
        self.counters: dict[str, int] = {}
        self.hits: dict[str, int] = {}
        self.bypassed: dict[str, int] = {}
        self.surfaces: dict[str, None] = {}

    def token(self, entity: str, surface: str, suffix: str | None) -> str:
        key = (entity, surface.lower())
        if key not in self.by_key:
            counter = self.counters.get(entity, 0)
            wanted = suffix or f"{counter + 1}A"
            number, token = max(counter, int(re.match("[0-9]+", wanted)[0])), rendered(entity, wanted, self.token_format)
            if self.by_token.get(token, (entity, surface))[1] != surface:
                number += 1
                while (token := rendered(entity, f"{number}A", self.token_format)) in self.by_token:
                    number += 1
            self.counters[entity] = number
            self.by_key[key] = token
            self.by_token[token] = (entity, surface)
        return self.by_key[key]

    def clean(self, text: str) -> str:
        """The text without invisible characters, look-alikes of tokens in double brackets unless the session has given them."""

        def escaped(m: re.Match) -> str:
            return m[0] if m[0].startswith("<<") or m[0] in self.by_token else f"<{m[0]}>"

        text = _INVISIBLE.sub("", text)
        return _LOOK_ALIKE.sub(escaped, text) if "<" in text else text

    def masked(self, text: str, spans: list[tuple]) -> str:
        """A clean text with the tokens of its spans."""
        out, at = [], 0
        for start, end, entity, surface, suffix in spans:
            gap, at = text[at:start], end
            if self.escape and gap.endswith("\\"):
                out += [gap[:-1], surface]
                self.bypassed[entity] = self.bypassed.get(entity, 0) + 1
                self.surfaces[surface] = None
            else:
                out += [gap, self.token(entity, surface, suffix)]
                self.hits[entity] = self.hits.get(entity, 0) + 1
        return "".join(out) + text[at:]

    def result(self, masked: list[str]) -> dict:
        entries = [{"token": t, "entity": e, "term": s} for t, (e, s) in sorted(self.by_token.items())]
        counts = {"max_group": self.counters, "hits": self.hits, "bypassed": self.bypassed}
        return {"masked": masked, "entries": entries, **{k: list(v.items()) for k, v in counts.items()}, "bypassed_surfaces": sorted(self.surfaces)}


def mask_strings(df: DataFrame, strings: str, dictionary: Dictionary, token_format: str = TOKEN_FORMAT, escape: bool = False) -> DataFrame:
    """df with masked, entries, max_group, hits, bypassed and bypassed_surfaces; the strings of a row's array are
    one session.

    masked: the cleaned strings with tokens for spans, null for null; tokens of earlier strings are left alone. entries: array<struct<token, entity, term>>
    by token. max_group: the highest token number of each entity; hits: how often it was found. escape: a
    backslash before a span keeps its surface and goes; bypassed counts such spans, bypassed_surfaces are their
    surfaces.
    """
    find = Finder(dictionary)

    @F.arrow_udf(_MASKED)
    @by_parts
    def tokens(texts: pa.Array) -> pa.Array:
        out = []
        for row in texts:
            session, row = _Session(token_format, escape), row.as_py()
            masked = []
            for text in row or ():
                clean = None if text is None else session.clean(text)
                masked.append(clean and session.masked(clean, find(clean)))
            out.append(session.result(row and masked))
        return pa.array(out, _MASKED_ARROW)

    df = df.withColumn("__done", tokens(F.col(strings)))
    return df.select(*[c for c in df.columns if c not in (*(f.name for f in _MASKED_ARROW), "__done")], "__done.*")


def mask(df: DataFrame, text: str, dictionary: Dictionary, token_format: str = TOKEN_FORMAT, escape: bool = False) -> DataFrame:
    """mask_strings() of one text a row: masked is the masked text."""
    df = mask_strings(df.withColumn("__texts", F.array(text)), "__texts", dictionary, token_format, escape)
    return df.withColumn("masked", F.get("masked", F.lit(0))).drop("__texts")


def restore_strings(df: DataFrame, masked: str, entries: str, token_format: str = TOKEN_FORMAT) -> DataFrame:
    """df with restored_text and restored: the strings of the array column masked with known tokens as their terms, in
    one pass, and unknown ones as they are, then double brackets as single ones; restored counts the known tokens."""
    pattern = token_pattern(token_format)

    @F.arrow_udf("struct<restored_text:array<string>,restored:bigint>")
    @by_parts
    def terms(texts: pa.Array, entries: pa.Array) -> pa.Array:
        out = []
        for row, known in zip(texts.to_pylist(), entries.to_pylist(), strict=True):
            by_token = {e["token"]: e["term"] for e in known or ()}
            n = 0

            def term(m: re.Match, by_token=by_token) -> str:
                nonlocal n
                n += m[0] in by_token
                return by_token.get(m[0], m[0])

            done = row and [None if t is None else _DOUBLE.sub(r"\1", pattern.sub(term, t)) for t in row]
            out.append({"restored_text": done, "restored": n})
        return pa.array(out, pa.struct([("restored_text", pa.list_(pa.string())), ("restored", pa.int64())]))

    df = df.withColumn("__back", terms(F.col(masked), F.col(entries)))
    return df.select(*[c for c in df.columns if c not in ("restored_text", "restored", "__back")], "__back.*")


def restore(df: DataFrame, masked: str, entries: str, token_format: str = TOKEN_FORMAT) -> DataFrame:
    """restore_strings() of one text a row: restored_text is the restored text."""
    df = restore_strings(df.withColumn("__texts", F.array(masked)), "__texts", entries, token_format)
    return df.withColumn("restored_text", F.get("restored_text", F.lit(0))).drop("__texts")


def mapping_relation(masked: DataFrame, *keys: str) -> DataFrame:
    """A row (keys, token, entity, term) for each entry."""
    return masked.select(*keys, F.inline_outer("entries")).filter("token IS NOT NULL")


def mapping_json(entries: Column, max_group: Column, token_format: str = TOKEN_FORMAT) -> Column:
    return F.to_json(F.struct(F.lit(1).alias("version"), F.lit(token_format).alias("tokenFormat"), entries.alias("entries"), max_group.alias("counters")))


def mapping_from_json(text: Column) -> Column:
    """A checked mapping: null unless it has version 1, at most 10,000 entries and none too long."""
    m = F.from_json(text, f"version int, tokenFormat string, entries array<{_ENTRY}>, counters map<string,int>")
    good = (m["version"] == 1) & (F.size(m["entries"]) <= 10_000) & F.forall(m["entries"], lambda e: (F.length(e["term"]) <= 1024) & (F.length(e["entity"]) <= 64) & (F.length(e["token"]) > 0))
    return F.when(good & m["tokenFormat"].rlike(r"^[<\[(][A-Za-z0-9_{}]+[>\])]$"), m)


def segments(text: Column, known: Column) -> Column:
    """array<struct<text, is_token>>: the text cut at the known tokens, without empty parts."""
    hits = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    pieces = F.split(text, TOKEN, -1)
    part = lambda t, k: F.struct(t.alias("text"), k.alias("is_token"))
    rest = F.flatten(F.zip_with(hits, F.slice(pieces, 2, F.greatest(F.size(hits), F.lit(1))), lambda h, p: F.array(part(h, F.array_contains(known, h)), part(F.coalesce(p, F.lit("")), F.lit(False)))))
    return F.filter(F.concat(F.array(part(F.get(pieces, 0), F.lit(False))), F.when(F.size(hits) > 0, rest).otherwise(F.array().cast("array<struct<text:string,is_token:boolean>>"))), lambda x: x["text"] != "")
