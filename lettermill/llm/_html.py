"""Rendering of HTML bodies to visible lines.

A mail body's HTML is rarely well formed, so tags are taken one by one from left
to right and no tree is built.  ``render`` gives the visible text with one line
per block; ``blocks`` also says for each line in which containers it stands.
"""

from __future__ import annotations

import html
import re

#: Element names of HTML 4 and 5 that occur in mail and pages.
ELEMENTS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite code col colgroup "
    "data dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i "
    "iframe img input ins kbd label legend li link main map mark math menu meta nav noframes noscript object ol optgroup option output p param picture pre "
    "progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th "
    "thead time title tr track tt u ul var video wbr".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body br center dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody tfoot thead tr ul".split()
)
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!doctype[^>]*>|<\?[^>]*>", re.I | re.S)
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\s[^<>]*)?)/?>")
_BREAK = re.compile(r"</?(?:" + "|".join(sorted(BLOCKS, key=len, reverse=True)) + r")(?:\s[^<>]*)?/?>", re.I)
_CELL = re.compile(r"</(?:td|th)\s*>", re.I)
_OTHER = re.compile(r"</?(?:" + "|".join(sorted(ELEMENTS, key=len, reverse=True)) + r")(?:\s[^<>]*)?/?>", re.I)


def render(value: str, extra: re.Pattern | None = None) -> str:
    """Visible text: own tags taken off and one level of character references resolved.

    ``extra``: a pattern of further tags, found by template deduction."""
    if "<" in value:
        text = HIDDEN.sub("", value)
        text = _BREAK.sub("\n", text)
        text = _CELL.sub("\t", text)
        text = _OTHER.sub("", text)
        if extra is not None:
            text = extra.sub("", text)
    else:
        text = value
    return html.unescape(text) if "&" in text else text


def blocks(value: str) -> list[tuple[str, int, int]]:
    """Lines as (text, depth of quotation, in a signature container)."""
    value = HIDDEN.sub("", value)
    out: list[tuple[str, int, int]] = []
    buf: list[str] = []
    stack: list[tuple[str, int]] = []
    quote = sig = 0
    at = 0

    def flush() -> None:
        line = "".join(buf)
        if "&" in line:
            line = html.unescape(line)
        for part in line.split("\n") if "\n" in line else (line,):
            out.append((part, quote, sig))
        buf.clear()

    for m in TAG.finditer(value):
        name = m[2].lower()
        if name not in ELEMENTS and ":" not in name:
            continue
        if m.start() > at:
            buf.append(value[at : m.start()])
        at = m.end()
        closing = m[1] == "/"
        if name in BLOCKS:
            if buf or name == "br":
                flush()
            if closing:
                while stack:
                    top, kind = stack.pop()
                    if kind == 1:
                        quote -= 1
                    elif kind == 2:
                        sig -= 1
                    if top == name:
                        break
            elif name not in ("br", "hr"):
                kind = 0
                attrs = m[3].lower()
                if name == "blockquote":
                    kind = 1
                elif attrs and ("gmail_quote" in attrs or "yahoo_quoted" in attrs or "moz-cite" in attrs):
                    kind = 3
                elif attrs and ("signature" in attrs):
                    kind = 2
                quote += kind == 1
                sig += kind == 2
                if name in ("div", "blockquote", "table", "p", "tr", "ul", "ol", "li", "pre", "body", "html"):
                    stack.append((name, kind))
        elif name in ("td", "th") and closing:
            buf.append("\t")
    if at < len(value):
        buf.append(value[at:])
    if buf:
        flush()
    return out
