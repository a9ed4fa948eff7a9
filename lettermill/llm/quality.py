"""Per-document text quality statistics (problem 10).

Every document is cut into chunks of ``CHUNK`` characters or less, at white space.  A chunk
gives the counts of its complete lines and, as its boundary state, the statistics of the
pieces of lines at its two ends: fixed numbers of fixed size, however long the line.
``merge`` joins two neighbours: the left one's tail and the right one's head are one line,
judged only then.  It is associative, so the chunks of a document are merged as a tree, in
arrays over all documents of a batch.  Texts of more than ``SPREAD`` characters are cut in
one pass, their parts spread over all tasks, and merged as a tree across tasks.  Ratios and
rule outcomes come from the merged counts.  A page printed in mirror writing has fewer
common words than common words read backwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batch import load, map_batches
from .unify import code_points

CHUNK, SPREAD, FAN = 1 << 11, 1 << 20, 64
#: Most frequent words of the languages in the data.
COMMON = frozenset(
    "the of and to in a is that it was for on with as by at be this which had not but from his are he were have an or their has been who will they its one all we said no at last when so"
    " der die das und in zu den von mit dem des im ist nicht ein eine auf für sich es an als auch wie bei am aus daß dass wird war um hat nach zur oder werden"
    " le la les de des du et en un une à est que qui dans il pour par sur au ne pas plus se ce a son sa ses avec été l d"
    " el los las y que en un una por con no para su al lo como más se pero sus"
    " i w z na do nie się że jest to o po jak ale od za и в не на что с по как к но из у за от это".split()
)
COUNTS = ("n_lines", "n_words", "word_chars", "n_chars", "n_symbols", "n_punct_lines", "n_common", "n_list", "n_table", "n_junk", "n_mirrored")
#: What is known of a piece of a line.  Sums over its words, then three facts of its first and last word, then the white space at its ends.
PIECE = ("tokens", "chars", "numbers", "legible", "read", "dots", "commas", "bars", "open", "caps", "hurt", "long", "words", "letters", "symbols", "common", "mirrored", "item", "cut", "closing", "lead", "trail")
SUMS, ITEM, CUT, CLOSING, LEAD, TRAIL = 17, 17, 18, 19, 20, 21
TOP = 0x3000
SMALL = frozenset("a an the of and to in at for from by with or on le la les de des du et en von zu und der die das den im am bei aus del y".split())
#: Characters that stand inside or beside words only where a page was misread.
STRAY = "#%&*^~=|<>\\_@`{}!;:?/\"[]()"
_LETTERS, _POWER = 48, np.uint64(1_099_511_628_211)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_LETTERS - 1, _POWER)]), dtype=np.uint64)


@lru_cache(1)
def tables() -> dict[str, np.ndarray]:
    chars = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(TOP)]
    of = lambda f: np.fromiter((bool(f(c)) for c in chars), bool, TOP)
    low = np.fromiter((ord(c.lower()[0]) for c in chars), np.uint64, TOP)
    in_ = lambda s: of(lambda c: c in s)
    t = {"letter": of(str.isalpha), "upper": of(str.isupper), "digit": of(str.isdecimal), "space": of(lambda c: c.isspace() or c == "\0"), "newline": in_("\n\0"), "low": low}
    t |= {"vowel": of(lambda c: c.lower() in "aeiouyäöüàâéèêëîïôùûœæáíóúąęаеёиоуыэюя"), "stray": in_(STRAY), "dot": in_(".…,·-_"), "end": in_(".!?…:;"), "close": in_("\"')]”’»"), "comma": in_(",;"), "bar": in_("|\t"), "cut": in_("-¬‐=")}
    t |= {"bullet": in_("-*•·–—+"), "money": in_("£$€+-"), "zero": in_("0156"), "point": in_(".)"), "symbol": of(lambda c: not c.isalnum() and not c.isspace() and c != "\0")}
    for name, words in (("common", COMMON), ("small", SMALL), ("mirrored", {w[::-1] for w in COMMON if len(w) > 1} - COMMON)):
        t[name] = np.array(sorted({int(sum(int(ord(c)) * int(p) for c, p in zip(w, _POWERS)) & (2**64 - 1)) for w in words}), np.uint64)
    return t


def _within(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


class Parts(NamedTuple):
    """Partial results, one a chunk: counts of complete lines, the pieces at both ends, and whether a line ends within (if not, ``tail`` says nothing)."""

    counts: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    broken: np.ndarray

    def take(self, at: np.ndarray) -> Parts:
        return Parts(*(x[at] for x in self))


def cuts(text: str, size: int) -> Iterator[str]:
    """The text in parts of ``size`` characters or less, cut behind white space; a longer word is cut where the size ends, and counts once a part."""
    at, n = 0, len(text)
    while n - at > size:
        end = at + size
        gap = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
        end = gap + 1 if gap >= at else end
        yield text[at:end]
        at = end
    yield text[at:]


def pieces(chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistics of every piece that has a word, its chunk, its line within all chunks); and lines begin anew with each chunk."""
    t = tables()
    cp, starts = code_points(chunks)
    c = np.where(cp < TOP, cp, 0x2E80)
    solid = ~t["space"][c]
    line_of = np.cumsum(t["newline"][c])
    if not solid.any():
        return np.zeros((0, len(PIECE)), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = np.flatnonzero(first)
    s = c[solid]
    offs = np.flatnonzero(first[solid])
    add = lambda x: np.add.reduceat(x, offs, dtype=np.int64)
    n = np.diff(np.append(offs, len(s)))
    last = s[offs + n - 1]
    letter = t["letter"][s]
    nl, nd, stray = add(letter), add(t["digit"][s]), add(t["stray"][s])
    low = t["low"][s]
    big = np.maximum.reduceat(np.where(letter, low, np.uint64(0)), offs)
    lowest = np.minimum.reduceat(np.where(letter, low, np.uint64(1 << 40)), offs)
    seen = np.cumsum(letter)
    place = seen - 1 - np.repeat(seen[offs] - letter[offs], n)
    keys = np.add.reduceat(np.where(letter & (place < _LETTERS), low * _POWERS[np.clip(place, 0, _LETTERS - 1)], np.uint64(0)), offs)
    head = s[offs]
    lead = t["digit"][head] | (t["money"][head] & (nd > 0))
    number = lead & (nd > 0) & (nl <= 2) & (n - nl - nd <= 3) & (add(t["stray"][s] & (s != ord(":")) & (s != ord(";")) & (s != ord("/"))) == 0)
    dots = (add(t["dot"][s]) == n) & (n > 3)
    # A stray character at the end of a word may be punctuation; within it, it isn't.
    tail_ok = (t["end"][last] | t["close"][last]).astype(np.int64)
    marred = (stray - tail_ok * (stray > 0) > 0) | ((nd > 0) & (nl > 0) & ~number)
    legible = (nl > 1) & (add(t["vowel"][s]) > 0) & (big != lowest) & ~marred & (nl * 10 >= n * 6)
    word = nl > 0
    upper = t["upper"][head] | t["zero"][head]
    open_ = word & ~_within(keys, t["small"])
    mark = ((n <= 4) & t["point"][last] & ((nl == 0) & (nd > 0) | (nl == 1) & (nd == 0))) | ((n == 1) & t["bullet"][head])
    closing = t["end"][last] | t["close"][last] & (n > 1) & t["end"][s[np.maximum(offs + n - 2, 0)]]
    # Words to pieces of lines.
    ln = line_of[at]
    new = np.concatenate([[True], ln[1:] != ln[:-1]])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(ln)) - 1
    gap = np.zeros(len(at), np.int64)
    gap[1:] = (at[1:] - (at[:-1] + n[:-1]) > 1) & ~new[1:]
    n_dots = n * dots
    sums = (np.ones(len(at), np.int64), n, number, legible, n * legible + n * number, n_dots, add(t["comma"][s]), add(t["bar"][s]) + gap + n_dots, open_, open_ & upper, marred & (n > 1), (n > 1) & ~number & ~dots,
            word, nl * word, add(t["symbol"][s]), word & _within(keys, t["common"]), word & _within(keys, t["mirrored"]))
    out = np.empty((len(lo), len(PIECE)), np.int64)
    for k, x in enumerate(sums):
        out[:, k] = np.add.reduceat(x.astype(np.int64), lo)
    out[:, ITEM], out[:, CUT], out[:, CLOSING] = mark[lo], t["cut"][last[hi]], closing[hi]
    ends = np.flatnonzero(t["newline"][c])
    at_line = ln[lo]
    out[:, LEAD] = at[lo] - np.where(at_line > 0, ends[at_line - 1] + 1, 0)
    out[:, TRAIL] = ends[at_line] - (at[hi] + n[hi])
    return out, np.searchsorted(starts, at[lo], "right") - 1, at_line


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pieces of lines with the pieces right behind them."""
    out = a + b
    x, y = a[:, 0] > 0, b[:, 0] > 0
    out[:, 7] += x & y & (a[:, TRAIL] + b[:, LEAD] > 1)
    out[:, ITEM] = np.where(x, a[:, ITEM], b[:, ITEM])
    for k in (CUT, CLOSING):
        out[:, k] = np.where(y, b[:, k], a[:, k])
    out[:, LEAD] = np.where(x, a[:, LEAD], out[:, LEAD])
    out[:, TRAIL] = np.where(y, b[:, TRAIL], out[:, TRAIL])
    return out


def judge(line: np.ndarray) -> np.ndarray:
    """The counts that whole lines give, one row each; a line without words gives zeros."""
    tokens, chars, numbers, legible, read, dots, commas, bars, open_, caps, hurt, long_, words, letters, symbols, common, mirrored = line[:, :SUMS].T
    some = tokens > 0
    value_row = (numbers >= 2) & ((numbers > legible) | (bars > 0) & (numbers >= legible))
    unread = (read * 2 < chars - np.where(numbers > 0, dots, 0)) & ~((numbers >= 3) & (numbers * 2 >= tokens))
    junk = some & (unread | (hurt * 10 >= long_ * 3) & (long_ >= 3) & ~value_row)
    table = some & ~junk & (value_row | (read * 2 < chars - dots))
    item = (tokens > 1) & (tokens <= 14) & (line[:, ITEM] > 0)
    entry = (commas > 0) & (tokens >= 2) & (tokens <= 10) & (open_ > 0) & (caps * 10 >= open_ * 8) & (open_ - 1 <= 2 * commas + 2) & (line[:, CUT] == 0)
    listed = some & ~junk & ~table & (item | entry)
    return np.stack([some, words, letters, np.zeros(len(line), np.int64), symbols, some * line[:, CLOSING], common, listed, table, junk, mirrored], 1).astype(np.int64)


def partials(chunks: list[str]) -> Parts:
    """The partial result of each chunk, all chunks of a batch at once."""
    n = len(chunks)
    stat, chunk, line = pieces(chunks)
    counts = np.zeros((n, len(COUNTS)), np.int64)
    ends = np.fromiter((x.count("\n") + x.count("\0") for x in chunks), np.int64, n)
    # The line numbers at which a chunk begins and ends: the end of a chunk counts as one.
    begin = np.concatenate([[0], np.cumsum(ends + 1)])[:n]
    head, tail = np.zeros((n, len(PIECE)), np.int64), np.zeros((n, len(PIECE)), np.int64)
    # Ends without a word have nothing but their white space.
    for k, x in enumerate(chunks):
        a, b = x[: x.find("\n") if ends[k] else len(x)], x[x.rfind("\n") + 1 :]
        if "\0" in x:
            a, b = x.replace("\0", "\n").split("\n", 1)[0], x.replace("\0", "\n").rsplit("\n", 1)[-1]
        if not a or a.isspace():
            head[k, [LEAD, TRAIL]] = len(a)
        if ends[k] and (not b or b.isspace()):
            tail[k, [LEAD, TRAIL]] = len(b)
    at_head = line == begin[chunk]
    at_tail = (line == begin[chunk] + ends[chunk]) & ~at_head
    head[chunk[at_head]], tail[chunk[at_tail]] = stat[at_head], stat[at_tail]
    inner = ~at_head & ~at_tail
    got = judge(stat[inner])
    for k in range(len(COUNTS)):
        counts[:, k] = np.bincount(chunk[inner], got[:, k], n).astype(np.int64)
    counts[:, 3] = np.fromiter(map(len, chunks), np.int64, n)
    return Parts(counts, head, tail, ends > 0)


def merge(a: Parts, b: Parts) -> Parts:
    """Parts with their right-hand neighbours."""
    seam = join(np.where(a.broken[:, None], a.tail, a.head), b.head)
    both = (a.broken & b.broken)[:, None]
    counts = a.counts + b.counts + np.where(both, judge(seam), 0)
    return Parts(counts, np.where(a.broken[:, None], a.head, seam), np.where(b.broken[:, None], b.tail, seam), a.broken | b.broken)


def tree(parts: Parts, group: np.ndarray) -> Parts:
    """Merges the parts of each group, given in order, by twos, then by fours, and so on."""
    while len(group) > 1 and (group[1:] == group[:-1]).any():
        place = np.arange(len(group)) - np.searchsorted(group, group)
        left = np.flatnonzero(place % 2 == 0)
        paired = np.append(group[1:], -1)[left] == group[left]
        merged = merge(parts.take(left[paired]), parts.take(left[paired] + 1))
        kept = parts.take(left)
        for x, y in zip(kept, merged):
            x[paired] = y
        parts, group = kept, group[left]
    return parts


def of_texts(texts: list[str], size: int = CHUNK) -> Parts:
    """The partial result of each text, from its chunks."""
    chunks, owner = [], []
    for k, x in enumerate(texts):
        own = list(cuts(x, size))
        chunks += own
        owner += [k] * len(own)
    return tree(partials(chunks), np.array(owner, np.int64))


def finish(parts: Parts) -> np.ndarray:
    """Counts of whole texts."""
    return parts.counts + judge(parts.head) + np.where(parts.broken[:, None], judge(parts.tail), 0)


def count_texts(texts: list[str], size: int = CHUNK) -> np.ndarray:
    """The counts of whole texts, one row each; all texts of a batch at once."""
    return finish(of_texts(texts, size)) if texts else np.zeros((0, len(COUNTS)), np.int64)


#: A part of a text on its way between tasks: text's row, place among its parts, partial result.
_PART = "row bigint, doc_id bigint, idx bigint, counts array<bigint>, head array<bigint>, tail array<bigint>, broken boolean"
_LIST = pa.list_(pa.int64())
_PART_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("idx", pa.int64()), ("counts", _LIST), ("head", _LIST), ("tail", _LIST), ("broken", pa.bool_())])


def _rows(batch, parts: Parts) -> pa.RecordBatch:
    cols = [*(batch.column(k) for k in range(3)), *(pa.array(list(x), _LIST) for x in parts[:3]), pa.array(parts.broken)]
    return pa.RecordBatch.from_arrays(cols, schema=_PART_ARROW)


def _cut(size: int):
    def run(batches):
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("idx", pa.int64()), ("text", pa.string())])
        for b in batches:
            for k in range(b.num_rows):
                # One text at a time, and of it one part at a time.
                row, doc, text = (b.column(c)[k].as_py() for c in range(3))
                for idx, x in enumerate(cuts(text, size)):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((row, doc, idx, x), schema.types)], schema=schema)

    return run


def _partial_rows(batches):
    for b in batches:
        for k in range(b.num_rows):
            one = b.slice(k, 1)
            yield _rows(one, of_texts([one.column(3)[0].as_py()]))


def _merge_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("idx")
    parts = Parts(*(np.stack(pdf[c].to_list()) for c in ("counts", "head", "tail")), pdf["broken"].to_numpy(bool))
    one = tree(parts, np.zeros(len(pdf), np.int64))
    return pd.DataFrame({"row": [key[0]], "doc_id": pdf["doc_id"].iloc[:1].tolist(), "idx": [key[1]], "counts": [one.counts[0]], "head": [one.head[0]], "tail": [one.tail[0]], "broken": [bool(one.broken[0])]})


def quality_counts(df: DataFrame, doc_id: str, text: str, chunk: int = CHUNK, spread: int = SPREAD, fan: int = FAN) -> DataFrame:
    """doc_id and the columns of COUNTS, one row per input row, also where ids are null or repeated.

    Null and empty texts give zeros.  A word longer than a chunk counts once a chunk.  Other
    columns are ignored.
    """
    src = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    names = ", ".join(f"{c} bigint" for c in COUNTS)

    def whole(batch: pa.RecordBatch) -> dict[str, list]:
        rows = count_texts(batch.column(1).to_pylist(), chunk)
        return {"doc_id": batch.column(0).to_pylist()} | {c: rows[:, k] for k, c in enumerate(COUNTS)}

    small = map_batches(src.where(F.length("text") <= spread), whole, f"doc_id bigint, {names}")
    # The row number tells texts apart whose ids are null or repeated; it is the same if a task runs again.
    large = src.withColumn("row", F.monotonically_increasing_id()).where(F.length("text") > spread).select("row", "doc_id", "text")
    parts = large.mapInArrow(_cut(spread), "row bigint, doc_id bigint, idx bigint, text string").repartition("row", "idx").mapInArrow(_partial_rows, _PART)
    reach = 1
    while reach * spread < 1 << 31:
        reach *= fan
        parts = parts.groupBy("row", F.floor(F.col("idx") / fan).cast("bigint").alias("group")).applyInPandas(_merge_group, _PART)

    def end(batch: pa.RecordBatch) -> dict[str, list]:
        n = batch.num_rows
        array = lambda k, width: np.array(batch.column(k).to_pylist(), np.int64).reshape(n, width)
        rows = finish(Parts(array(3, len(COUNTS)), array(4, len(PIECE)), array(5, len(PIECE)), np.array(batch.column(6).to_pylist(), bool)))
        return {"doc_id": batch.column(1).to_pylist()} | {c: rows[:, k] for k, c in enumerate(COUNTS)}

    return small.unionByName(map_batches(parts, end, f"doc_id bigint, {names}"))


def ratios(counts: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    half = lambda c: F.col(c) * 2 > F.col("n_lines")
    return counts.select(
        "doc_id",
        "n_words",
        share("word_chars", "n_words").alias("mean_word_length"),
        share("n_symbols", "n_chars").alias("symbol_ratio"),
        share("n_punct_lines", "n_lines").alias("punct_line_share"),
        share("n_common", "n_words").alias("common_word_share"),
        F.when(half("n_junk") | (F.col("n_mirrored") > F.col("n_common")) & (F.col("n_mirrored") > 3), "junk").when(half("n_table"), "table").when(half("n_list"), "list").otherwise("prose").alias("kind"),
    )


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = ratios(quality_counts(load(spark, sf_dir, "documents"), "doc_id", "text"))
    return stats.where("kind <> 'prose'").select("doc_id", "kind").distinct()


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratios(quality_counts(load(spark, sf_dir, "documents"), "doc_id", "text"))


#: White space below TOP, as a class.
_GAP = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}]"


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words))


def statistics_sql() -> str:
    """``p10_statistics`` over the table documents: words as rows, then lines, then pages, with no chunk."""
    def n(cls: str, c: str = "w") -> str:
        """How many characters of a word are in a class."""
        return f"(length({c}) - length(regexp_replace({c}, '[{cls}]', '', 'g')))"

    esc = lambda chars: "".join(f"\\x{{{ord(c):X}}}" for c in chars)
    has = lambda c, chars: f"regexp_matches({c}, '^[{esc(chars)}]$')"
    vowels = "aeiouyäöüàâéèêëîïôùûœæáíóúąęаеёиоуыэюя"
    mirrored = {w[::-1] for w in COMMON if len(w) > 1} - COMMON
    return rf"""
WITH lines_ AS (SELECT doc_id, text, generate_subscripts(l, 1) AS ln, unnest(l) AS line FROM (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
bare AS (SELECT doc_id, ln, regexp_replace(regexp_replace(line, '^{_GAP}+', ''), '{_GAP}+$', '') AS line FROM lines_),
split_ AS (SELECT doc_id, ln, string_split_regex(line, '{_GAP}+') AS ws, len(regexp_extract_all(line, '{_GAP}{{2,}}')) AS gaps FROM bare WHERE line <> ''),
words_ AS (SELECT doc_id, ln, gaps, generate_subscripts(ws, 1) AS k, len(ws) AS nw, unnest(ws) AS w FROM split_),
f AS (SELECT *, length(w) AS n, {n(r'\p{L}')} AS nl, {n(r'\p{Nd}')} AS nd, {n(esc(STRAY))} AS stray, left(w, 1) AS a, right(w, 1) AS z, CASE WHEN length(w) > 1 THEN left(right(w, 2), 1) ELSE '' END AS y, lower(regexp_replace(w, '\P{{L}}', '', 'g')) AS key FROM words_),
g AS (SELECT *, (regexp_matches(a, '\p{{Nd}}') OR {has('a', '£$€+-')} AND nd > 0) AND nd > 0 AND nl <= 2 AND n - nl - nd <= 3 AND {n(esc([c for c in STRAY if c not in ':;/']))} = 0 AS number, regexp_matches(w, '^[{esc('.…,·-_')}]+$') AND n > 3 AS dots, {has('z', '.!?…:;')} AS fin, {has('z', chr(34) + "')]”’»")} AS shut FROM f),
h AS (SELECT *, stray - CASE WHEN stray > 0 AND (fin OR shut) THEN 1 ELSE 0 END > 0 OR nd > 0 AND nl > 0 AND NOT number AS marred FROM g),
t AS (SELECT *, nl > 1 AND regexp_matches(key, '[{vowels}]') AND NOT regexp_matches(key, '^(' || left(key, 1) || ')+$') AND NOT marred AND nl * 10 >= n * 6 AS legible, nl > 0 AS word, nl > 0 AND key NOT IN ({_quoted(SMALL)}) AS content FROM h),
l AS (SELECT doc_id, ln, count(*) AS tokens, sum(n) AS chars, count(*) FILTER (WHERE number) AS numbers, count(*) FILTER (WHERE legible) AS legible, sum(CASE WHEN legible THEN n ELSE 0 END + CASE WHEN number THEN n ELSE 0 END) AS read, sum(CASE WHEN dots THEN n ELSE 0 END) AS dots,
  sum({n(',;')}) AS commas, sum({n('|')}) + any_value(gaps) + sum(CASE WHEN dots THEN n ELSE 0 END) AS bars, count(*) FILTER (WHERE content) AS open, count(*) FILTER (WHERE content AND (regexp_matches(a, '\p{{Lu}}') OR {has('a', '0156')})) AS caps,
  count(*) FILTER (WHERE marred AND n > 1) AS hurt, count(*) FILTER (WHERE n > 1 AND NOT number AND NOT dots) AS long, count(*) FILTER (WHERE word) AS words, sum(nl) AS letters, sum({n(r'^\p{L}\p{N}')}) AS symbols, count(*) FILTER (WHERE word AND key IN ({_quoted(COMMON)})) AS common, count(*) FILTER (WHERE word AND key IN ({_quoted(mirrored)})) AS mirrored,
  bool_or(k = 1 AND (n <= 4 AND {has('z', '.)')} AND (nl = 0 AND nd > 0 OR nl = 1 AND nd = 0) OR n = 1 AND {has('a', '-*•·–—+')})) AS item, bool_or(k = nw AND {has('z', '-¬‐=')}) AS cut, bool_or(k = nw AND (fin OR shut AND {has('y', '.!?…:;')})) AS closing FROM t GROUP BY doc_id, ln),
v AS (SELECT *, numbers >= 2 AND (numbers > legible OR bars > 0 AND numbers >= legible) AS value_row FROM l),
j AS (SELECT *, read * 2 < chars - CASE WHEN numbers > 0 THEN dots ELSE 0 END AND NOT (numbers >= 3 AND numbers * 2 >= tokens) OR hurt * 10 >= long * 3 AND long >= 3 AND NOT value_row AS junk FROM v),
r AS (SELECT *, NOT junk AND (value_row OR read * 2 < chars - dots) AS "table" FROM j),
q AS (SELECT *, NOT junk AND NOT "table" AND (tokens > 1 AND tokens <= 14 AND item OR commas > 0 AND tokens BETWEEN 2 AND 10 AND open > 0 AND caps * 10 >= open * 8 AND open - 1 <= 2 * commas + 2 AND NOT cut) AS listed FROM r),
c AS (SELECT d.doc_id, any_value(length(coalesce(d.text, ''))) AS n_chars, count(q.ln) AS n_lines, coalesce(sum(words), 0) AS n_words, coalesce(sum(letters), 0) AS letters, coalesce(sum(symbols), 0) AS symbols, count(*) FILTER (WHERE closing) AS n_punct, coalesce(sum(common), 0) AS common, coalesce(sum(mirrored), 0) AS mirrored,
  count(*) FILTER (WHERE listed) AS n_list, count(*) FILTER (WHERE "table") AS n_table, count(*) FILTER (WHERE junk) AS n_junk FROM documents d LEFT JOIN q USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CASE WHEN n_words > 0 THEN CAST(letters AS DOUBLE) / n_words END AS mean_word_length, CASE WHEN n_chars > 0 THEN CAST(symbols AS DOUBLE) / n_chars END AS symbol_ratio, CASE WHEN n_lines > 0 THEN CAST(n_punct AS DOUBLE) / n_lines END AS punct_line_share,
  CASE WHEN n_words > 0 THEN CAST(common AS DOUBLE) / n_words END AS common_word_share, CASE WHEN n_junk * 2 > n_lines OR mirrored > common AND mirrored > 3 THEN 'junk' WHEN n_table * 2 > n_lines THEN 'table' WHEN n_list * 2 > n_lines THEN 'list' ELSE 'prose' END AS kind FROM c"""


def found_sql() -> str:
    return f"SELECT DISTINCT doc_id, kind FROM ({statistics_sql()}) WHERE kind <> 'prose'"
