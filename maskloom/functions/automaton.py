"""Many terms at once: an Aho-Corasick automaton over folded text, with a map back to the text's own offsets.

Folding puts characters into one case and white-space runs into one space. It may equate more characters than a
term's pattern does (as the Kelvin sign and k), so a hit is compared with its term before it counts. The time of a
search grows with the text and its hits, not with the number of terms.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

from maskloom.functions.regexlang import HANGUL_CJK, SPACE

_RUN = re.compile(f"[{SPACE}]+")
_SPACES = [c for c in map(chr, range(0x10000)) if _RUN.match(c) and c != " "]
_LONG_RUN = re.compile("  +")
_CJK = re.compile(f"[{HANGUL_CJK}]")
_ASCII_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def _folded_char(c: str) -> str:
    up = c.upper()
    low = (up if len(up) == 1 else c).lower()
    return low if len(low) == 1 else c


class _Fold(dict):
    def __missing__(self, c: int) -> str:
        self[c] = _folded_char(chr(c))
        return self[c]


_FOLD = _Fold()


@cache
def _uneven() -> re.Pattern:
    """Characters that fold to something else than lower() gives; that of a sigma depends on its place."""
    odd = [c for c in range(128, 0x20000) if _folded_char(chr(c)) != chr(c).lower()]
    return re.compile(f"[{''.join(map(chr, odd))}\u03a3]")


def folded(text: str) -> str:
    """Each character in one case; the length stays."""
    return text.lower() if text.isascii() or not _uneven().search(text) else text.translate(_FOLD)


class Folded:
    """A text as the automaton reads it, and the way back."""

    __slots__ = ("at", "cut", "text")

    def __init__(self, text: str):
        self.at: list[int] = []  # offsets behind the runs that became one space
        self.cut: list[int] = []  # and how much was left out up to there
        out = folded(text)
        for c in _SPACES:
            if c in out:
                out = out.replace(c, " ")
        if "  " in out:
            gone = 0
            for m in _LONG_RUN.finditer(out):
                gone += m.end() - m.start() - 1
                self.at.append(m.end() - gone)
                self.cut.append(gone)
            out = _LONG_RUN.sub(" ", out)
        self.text = out

    def offset(self, k: int) -> int:
        """The offset in the text of a folded character that is no space."""
        n = bisect_right(self.at, k)
        return k + self.cut[n - 1] if n else k


@dataclass(frozen=True)
class Spelling:
    """A term to look for. strict: not behind a Hangul or CJK character; any_case: else as it is written."""

    term: str
    strict: bool = False
    any_case: bool = True


class TermFinder:
    """Where terms occur in texts: with any white space between words and not inside of an ASCII word."""

    def __init__(self, spellings: Sequence[Spelling]):
        import ahocorasick

        self.spellings = [s for s in spellings]
        self.words = [_RUN.split(s.term.strip()) for s in self.spellings]
        of: dict[str, list[int]] = {}
        for k, words in enumerate(self.words):
            if words[0]:
                of.setdefault(folded(" ".join(words)), []).append(k)
        self.ascii = [s.term.isascii() and s.any_case for s in self.spellings]
        self.left = [self._left(s.term.strip()[:1], s.strict) for s in self.spellings]
        self.right = [s.term.strip()[-1:] in _ASCII_WORD if s.term.strip() else False for s in self.spellings]
        self.shortest = min(map(len, of), default=0)
        # none can be in a text without an ASCII letter or digit
        self.plain = all(s.term.isascii() and re.search("[A-Za-z0-9]", s.term) for s in self.spellings)
        self.found = None
        if of:
            self.found = ahocorasick.Automaton()
            for text, ids in of.items():
                self.found.add_word(text, (len(text), ids))
            self.found.make_automaton()

    @staticmethod
    def _left(first: str, strict: bool) -> int:
        return 1 if first in _ASCII_WORD and first else 2 if strict and _CJK.match(first) else 0

    def _same(self, k: int, surface: str) -> bool:
        """Whether a surface is a spelling of the term."""
        if self.ascii[k] and surface.isascii():
            return True
        there, any_case = " ".join(_RUN.split(surface)), self.spellings[k].any_case
        return all(x == c or (any_case and _either(x, c)) for x, c in zip(there, " ".join(self.words[k]), strict=True))

    def occurrences(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, number of the spelling) of all, by end; they may overlap."""
        if self.found is None or len(text) < self.shortest or (self.plain and not re.search("[A-Za-z0-9]", text)):
            return
        there = Folded(text)
        for last, (n, ids) in self.found.iter(there.text):
            start, end = (there.offset(last - n + 1), there.offset(last) + 1) if there.at else (last - n + 1, last + 1)
            for k in ids:
                if self.right[k] and text[end : end + 1] in _ASCII_WORD and end < len(text):
                    continue
                if start and self.left[k] and (text[start - 1] in _ASCII_WORD if self.left[k] == 1 else _CJK.match(text, start - 1)):
                    continue
                if self._same(k, text[start:end]):
                    yield start, end, k

    def leftmost(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, number of the spelling): from the left, without overlap; of those that start at one place that of the
        lowest number."""
        out, reach = [], 0
        for start, end, k in sorted(self.occurrences(text), key=lambda x: (x[0], x[2])):
            if start >= reach:
                out.append((start, end, k))
                reach = end
        return out

    def present(self, text: str) -> set[int]:
        """The numbers of the spellings that occur."""
        return {k for _, _, k in self.occurrences(text)}


def _either(x: str, c: str) -> bool:
    """Whether a character is the other case of a term's character; both have to be single characters."""
    low, up = c.lower(), c.upper()
    return len(low) == len(up) == 1 and x in (low, up)
