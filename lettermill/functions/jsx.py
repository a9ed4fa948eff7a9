"""Columns for string rules that differ from Java's: white space, word edges, line ends.

White space is Unicode's with the byte-order mark, word edges are ASCII, `.` stops at the four
line ends, and lengths count code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white-space set, in a character class and negated.
_SET = r"\t-\r    -     　﻿"
WS, NWS = f"[{_SET}]", f"[^{_SET}]"
DOT = r"[^\n\r  ]"
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
END = r"\z"


def pattern(text: str) -> str:
    """A Java pattern from one in which <s>, <S>, <.>, <b>, b> and <$> stand for the sets and edges above."""
    for mark, to in (("<s>", WS), ("<S>", NWS), ("<.>", DOT), ("<b>", LEFT), ("<e>", RIGHT), ("<$>", END)):
        text = text.replace(mark, to)
    return text


#: The white-space set as the characters themselves.
BLANKS = "".join(chr(c) for c in (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))


def js_trim(c: Column) -> Column:
    """Without white space at both ends; no pattern, as one for the end of a text tries every gap before it."""
    return F.btrim(c, F.lit(BLANKS))


def split_lines(c: Column) -> Column:
    return F.split(c, r"\r?\n", -1)


def matches(c: Column, text: str) -> Column:
    return c.rlike(pattern(text))


def first_position(c: Column, text: str) -> Column:
    """Code points before the first match; the length where nothing matches."""
    return F.length(F.element_at(F.split(c, pattern(text), 2), 1))


def holds_any(low: Column, words: tuple[str, ...]) -> Column:
    """Whether a lower-case text holds one of some literals: a plain byte search, as a gate before patterns.

    The text is computed once: in a chain of alternatives, each would compute it anew.
    """
    return let(low, lambda x: reduce(lambda a, b: a | b, [x.contains(w) for w in words]))


def holds_all(low: Column, words: tuple[str, ...]) -> Column:
    out = low.contains(words[0])
    for w in words[1:]:
        out = out & low.contains(w)
    return out


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` takes it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
