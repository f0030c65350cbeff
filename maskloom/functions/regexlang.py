"""Dictionary regular expressions in one dialect, for Java (columns) and Python (Arrow functions).

Patterns are written with ASCII \\b, \\w and \\d and with a white-space class that knows Unicode spaces.
Java's \\b and \\s mean something else, so a pattern is translated before it becomes a column.
"""

from __future__ import annotations

import re

#: The white space of patterns; Hangul and CJK, which a strict term may not follow.
SPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
HANGUL_CJK = r"\uac00-\ud7a3\u1100-\u11ff\u3130-\u318f\u4e00-\u9fff\u3400-\u4dbf"
LINE_ENDS = r"\n\r\u2028\u2029"
#: Fixed value: repetition of a repeated group, which can take exponential time.
NESTED_REPETITION = r"\([^)]*[\*\+][^)]*\)[\*\+]|\([^)]*\{[0-9]+,?[0-9]*\}[^)]*\)[\*\+]|\([^)]*[\*\+][^)]*\)\{[0-9]+,?[0-9]*\}|[\*\+]{2,}"
_WORD = "[A-Za-z0-9_]"
_EDGE = rf"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_NO_EDGE = rf"(?:(?<!{_WORD})(?!{_WORD})|(?<={_WORD})(?={_WORD}))"


def escaped(text: str) -> str:
    """text as a pattern that matches it, in Java and Python."""
    return re.sub(r"([.*+?^${}()|\[\]\\/&~#-])", r"\\\1", text)


def translated(pattern: str, java: bool = True) -> str:
    """The pattern for Java, or for Python's re with re.ASCII."""
    out, k, inside = [], 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            n = pattern[k + 1]
            k += 2
            if n == "s":
                out.append(SPACE if inside else f"[{SPACE}]")
            elif n == "S":
                if inside and not java:
                    raise ValueError(r"\S inside of a class")
                out.append(f"[^{SPACE}]")
            elif n == "b":
                out.append(r"\x08" if inside else _EDGE)
            elif n == "B" and not inside:
                out.append(_NO_EDGE)
            else:
                out.append("/" if n == "/" else c + n)
            continue
        k += 1
        if inside:
            out.append("\\[" if c == "[" else "\\&" if c == "&" else c)
            inside = c != "]"
        elif c == "[":
            inside = True
            out.append(c)
            if pattern[k : k + 1] == "^":
                out.append("^")
                k += 1
        else:
            out.append({".": f"[^{LINE_ENDS}]", "$": r"\z" if java else r"\Z"}.get(c, c))
    return "".join(out)


def _either_case(c: str) -> str:
    low, up = c.lower(), c.upper()
    if len(low) == len(up) == 1 and low != up:
        return f"[{escaped(low)}{escaped(up)}]"
    return escaped(c)


def term_pattern(term: str, strict: bool = False, any_case: bool = True) -> str:
    """A pattern that finds a term: in any case, with any white space between its words, not inside of an ASCII
    word, and, if strict, not behind a Hangul or CJK character."""
    spell = _either_case if any_case else escaped
    words = [w for w in re.split(f"[{SPACE}]+", term.strip()) if w]
    body = f"[{SPACE}]+".join("".join(map(spell, w)) for w in words)
    first, last = words[0][0], words[-1][-1]
    before = after = ""
    if first.isascii() and first.isalnum():
        before = "(?<![A-Za-z0-9])"
    elif strict and re.match(f"[{HANGUL_CJK}]", first):
        before = f"(?<![{HANGUL_CJK}])"
    if last.isascii() and last.isalnum():
        after = "(?![A-Za-z0-9])"
    return before + body + after
