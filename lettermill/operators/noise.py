"""Boilerplate at the end of bodies: client lines, list footers, disclaimers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.jsx import holds_any, js_trim, matches, pattern, split_lines


#: All marks as one pattern, so that a line is read once.
_ALL = "(?i)" + "|".join(f"(?:{p.removeprefix('(?i)')})" for p in V.NOISE)


def is_noise(line: Column) -> Column:
    return matches(line, _ALL)


def _hinted(text: Column) -> Column:
    """Whether a text may hold boilerplate at all: most don't, and aren't searched by line or block."""
    return holds_any(F.lower(text), V.NOISE_HINTS)


def strip_noise(text: Column) -> Column:
    """Drops the first line of boilerplate and all below it; line ends become LF."""
    lines = split_lines(text)
    at = F.array_position(F.transform(lines, lambda x: _hinted(x) & is_noise(x)), True)
    cut = F.array_join(F.when(at > 0, F.slice(lines, 1, (at - 1).cast("int"))).otherwise(lines), "\n")
    return js_trim(F.when(_hinted(text), cut).otherwise(F.replace(text, F.lit("\r\n"), F.lit("\n"))))


def block_text(block: Column) -> Column:
    """Visible text of an HTML block on one line."""
    bare = F.regexp_replace(block, "<[^>]+>", " ")
    bare = F.regexp_replace(bare, "(?i)&[a-z]+;", " ")
    return js_trim(F.regexp_replace(bare, pattern("<s>+"), " "))


def html_blocks(html: Column) -> Column:
    """The parts of the HTML, each with the closing tag it ends in."""
    return F.split(html, V.BLOCK_END, -1)


def strip_noise_html(html: Column) -> Column:
    """Drops the first block of boilerplate and all after it."""
    blocks = html_blocks(html)
    at = F.array_position(F.transform(blocks, lambda b: is_noise(block_text(b))), True)
    cut = F.array_join(F.when(at > 0, F.slice(blocks, 1, (at - 1).cast("int"))).otherwise(blocks), "")
    # A block's phrase may be parted by tags and gaps: hints are looked for in the flat text.
    return js_trim(F.when(_hinted(block_text(html)), cut).otherwise(html))
