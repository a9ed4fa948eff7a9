"""Garbled text from wrong character encoding (problem 5).

Pass 1 counts adjacent character pairs over the whole corpus; characters are
folded to ``K`` classes, so the table has at most K * K cells whatever the
corpus.  From it come the mutual information of a pair, shrunk towards none for
rare characters, and the surprisal of reading b after a.  Pass 2 finds in each
value the maximum-scoring segments of surprisal above ``LEVEL`` and tests the
inverse mappings (re-encode with the encoding wrongly used, decode with the
right one) inside the words of those segments alone.  A mapping counts where it lowers the
surprisal of the segment by ``GAIN`` nats or more.  Characters that were lost on the way
(U+FFFD) come back from the attachment's own bytes where these still hold them.
"""

from __future__ import annotations

import re
import string
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.charset import decode
from ..functions.parsers import html_text
from ..functions.routing import detect_route
from ._batch import cut_lineage, load, map_batches
from .unify import code_points

#: Encodings that text is wrongly read in, and its own ones.
WRONG = ("cp1252", "cp437", "mac_roman", "cp1251", "koi8_r", "cp866", "cp850", "cp1250", "iso8859_2", "mac_cyrillic", "latin_1", "iso8859_5")
RIGHT = ("utf_8", "cp1251", "cp1252", "koi8_r", "cp1250", "iso8859_2", "cp437", "cp850", "cp866", "mac_roman", "mac_cyrillic", "iso8859_5")
LEVEL, GAIN, SHRINK = 4.6, 3.0, 0.02
#: Ids (8 bytes each) that are sent to all tasks.
MOST_SENT = 1_000_000
_RANGES = ((0, 0x180), (0x2C0, 0x2E0), (0x370, 0x530), (0x2000, 0x2070), (0x20A0, 0x20D0), (0x2100, 0x2150), (0x2190, 0x2320), (0x2500, 0x2600), (0xFB00, 0xFB07), (0xFFFD, 0xFFFE))
K = sum(b - a for a, b in _RANGES) + 2


@lru_cache(1)
def fold_table() -> np.ndarray:
    t = np.full(0x10000, K - 1, np.int32)
    n = 0
    for a, b in _RANGES:
        t[a:b] = np.arange(n, n + b - a)
        n += b - a
    for c in range(0x530):
        low = chr(c).lower()
        if len(low) == 1 and 0 < t[ord(low)] < K - 1:  # case tells nothing here: headings are in capitals
            t[c] = t[ord(low)]
    t[ord("1") : ord("9") + 1] = t[ord("0")]
    for c in "\n\r\t\0":
        t[ord(c)] = t[ord(" ")]
    return t


def fold(cp: np.ndarray) -> np.ndarray:
    return fold_table()[np.where(cp < 0x10000, cp, 0xFFFF - 2)]


def _decode(b: int, enc: str) -> str:
    try:
        return bytes([b]).decode(enc)
    except UnicodeDecodeError:
        return chr(b)  # as lenient readers do


@lru_cache(1)
def inverses() -> dict[str, dict[str, int]]:
    """By encoding wrongly used, the byte of each character beyond ASCII."""
    return {w: {_decode(b, w): b for b in range(128, 256)} for w in WRONG}


@lru_cache(1)
def readings() -> dict[str, list[str] | None]:
    """By right encoding, the character of each byte; None where several bytes make one."""
    return {r: None if r == "utf_8" else [_decode(b, r) for b in range(256)] for r in RIGHT}


def pair_counts(df: DataFrame, text: str) -> DataFrame:
    """pair (a * K + b) and n over all values."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        values = [v for v in batch.column(0).to_pylist() if v]
        if not values:
            return {"pair": [], "n": []}
        c = fold(code_points(values)[0]).astype(np.int64)
        n = np.bincount(c[:-1] * K + c[1:], minlength=1)
        at = np.flatnonzero(n)
        return {"pair": at, "n": n[at]}

    return map_batches(df.select(F.col(text).cast("string")), run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def surprisal(pair: np.ndarray, n: np.ndarray) -> np.ndarray:
    """-log p(b|a) as K x K table: -(shrunk mutual information + log p(b))."""
    joint = np.zeros(K * K)
    joint[pair] = n
    joint = joint.reshape(K, K)
    total = max(joint.sum(), 1.0)
    a = joint.sum(1)
    b = (joint.sum(0) + 0.5) / (total + 0.5 * K)
    m = SHRINK * total + 1.0
    return -np.log((joint + m * b[None, :]) / (a[:, None] + m)).astype(np.float32)


def segments(score: np.ndarray) -> list[tuple[int, int]]:
    """All maximal scoring segments (Ruzzo and Tompa), as half-open ranges.

    Neighbours of one sign are never parted, so runs of them are taken at once.
    """
    up = score > 0
    if not up.any():
        return []
    edge = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
    end = np.append(edge[1:], len(score))
    sums = np.add.reduceat(score.astype(np.float64), edge)
    total = np.cumsum(sums)
    rise = up[edge]
    # Begin, end, sum before, sum after, and place of the last one before with a smaller sum before: the search goes along these.
    stack: list[tuple[int, int, float, float, int]] = []
    for lo, hi, left, right in zip(edge[rise].tolist(), end[rise].tolist(), (total - sums)[rise].tolist(), total[rise].tolist()):
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((lo, hi, left, right, j))
                break
            lo, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [x[:2] for x in stack]


_NON_ASCII = re.compile(r"[^\x00-\x7f]+")
_BAD = re.compile(r"[\x80-\x9f�]")


def costs(texts: list[str], table: np.ndarray) -> np.ndarray:
    """The surprisal of each text, all in one look-up."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    c = fold(cp)
    step = np.concatenate([table[c[:-1], c[1:]], [0]]).astype(np.float64)
    end = np.cumsum(size)
    step[end - 1] = 0.0  # from one text to the next
    return np.add.reduceat(step, end - size)


def mapped(word: str) -> dict[str, str]:
    """What the inverse mappings make of a word: text, and the mapping that gave it first."""
    pieces = _NON_ASCII.split(word)
    runs = _NON_ASCII.findall(word)
    chars = set("".join(runs))
    out: dict[str, str] = {}
    tried: set[bytes] = set()
    for w, to_byte in inverses().items():
        if not chars <= to_byte.keys():
            continue
        raw = [bytes(to_byte[c] for c in r) for r in runs]
        key = b"\0".join(raw)
        if key in tried:  # encodings agree on most letters: the same bytes read the same
            continue
        tried.add(key)
        for r, to_char in readings().items():
            if to_char is None:
                try:
                    back = [x.decode("utf_8") for x in raw]
                except UnicodeDecodeError:
                    continue
            elif r == w:
                continue
            else:
                back = ["".join([to_char[b] for b in x]) for x in raw]
            new = "".join(x for pair in zip(pieces, [*back, ""]) for x in pair)
            if new != word and new not in out and not _BAD.search(new):
                out[new] = f"{w}>{r}"
    return out


#: Punctuation that sound text has at the ends of words.
_TYPOGRAPHIC = "–—‘’‚“”„…«»‹›€•·°" + string.punctuation
_SPACES = np.array([9, 10, 13, 32], np.int32)
#: Words already mapped by the table of this fingerprint: they recur in all batches of a worker.
_CACHE: dict[str, tuple[str, float, str]] = {}
_CACHE_OF: list[int] = [0]
_CACHE_SIZE = 200_000


def best_mapping(word: str, table: np.ndarray) -> tuple[str, float, str]:
    """(restored, nats gained, mapping) of a word; the same words recur, so they are kept."""
    hit = _CACHE.get(word)
    if hit is None:
        hit = (word, 0.0, "")
        tries = mapped(word)
        if tries:
            news = list(tries)
            cost = costs([f" {x} " for x in (word, *news)], table)
            gain = cost[0] - cost[1:]
            # It must also read better by the pair: fewer characters alone make no better text.
            size = np.fromiter(map(len, news), np.int64, len(news))
            gain[cost[1:] * (len(word) + 1) >= cost[0] * (size + 1)] = 0.0
            k = int(gain.argmax())
            if gain[k] >= max(GAIN, 0.4 * sum(c > "\x7f" for c in word)):
                hit = (news[k], float(gain[k]), tries[news[k]])
        if len(_CACHE) > _CACHE_SIZE:
            _CACHE.clear()
        _CACHE[word] = hit
    return hit


def remap(line: str, name: str) -> str | None:
    """The line with all characters beyond ASCII taken back by one mapping; None where that cannot be."""
    w, r = name.split(">")
    to_byte, to_char = inverses()[w], readings()[r]
    try:
        if to_char is None:
            return _NON_ASCII.sub(lambda m: bytes(to_byte[c] for c in m[0]).decode("utf_8"), line)
        return "".join([c if c < "\x80" else to_char[to_byte[c]] for c in line])
    except (KeyError, UnicodeDecodeError):
        return None


def repair(text: str, table: np.ndarray) -> tuple[str, float, str]:
    """The text with its garbled words restored, the nats gained, and the mapping used most."""
    if text.isascii():
        return text, 0.0, ""
    cp = np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    c = fold(cp)
    found = segments(table[c[:-1], c[1:]] - LEVEL)
    if not found:
        return text, 0.0, ""
    # The words that a segment touches, of those with characters beyond ASCII, are taken one by one.
    turn = np.zeros(len(text) + 1, np.int64)
    a, b = np.array(found).T
    np.add.at(turn, a, 1)
    np.add.at(turn, b, -1)
    own = cp[1:]
    solid = ~np.isin(own, _SPACES)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], solid.astype(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    high = np.concatenate([[0], np.cumsum(own > 0x7F)])
    touched = np.concatenate([[0], np.cumsum(np.cumsum(turn[:-1]) > 0)])
    pick = (high[end] > high[begin]) & (touched[end] > touched[begin])
    out, at, gained, used = [], 0, 0.0, {}
    for a, b in zip(begin[pick].tolist(), end[pick].tolist()):
        word = text[a:b]
        if word.strip(_TYPOGRAPHIC).isascii():
            continue
        new, gain, name = best_mapping(word, table)
        if name:
            out += [text[at:a], new]
            at = b
            gained += gain
            used[name] = used.get(name, 0) + len(word)
    new, name = "".join(out) + text[at:], max(used, key=used.get) if used else ""
    if not name:
        return new, gained, name
    # Words too short to tell by themselves go with their line, if all of it reads better by the mapping used most.
    lines = new.split("\n")
    before = text.split("\n")
    for k, (a, b) in enumerate(zip(before, lines)):
        whole = remap(a, name) if a != b else None
        if whole is not None and whole != b and not _BAD.search(whole):
            was, now = costs([f" {b} ", f" {whole} "], table)
            if now < was:
                lines[k] = whole
    return "\n".join(lines), gained, name


def garbled(df: DataFrame, record_id: str, text: str, with_text: bool = True) -> DataFrame:
    """record_id, mapping, gain, lost (count of lost characters), restored; one row per garbled value.

    Null and empty values give no row and repeated rows repeated rows.  The table
    of pairs that goes to the tasks has K * K cells (about 10 MB) at most.
    """
    spark = df.sparkSession
    rows = pair_counts(df, text).toPandas()  # at most K * K rows
    table = surprisal(rows["pair"].to_numpy(np.int64), rows["n"].to_numpy(np.float64))
    sent, fingerprint = spark.sparkContext.broadcast(table), zlib.crc32(table.tobytes())
    src = df.select(F.col(record_id).cast("bigint").alias("__id"), F.col(text).cast("string").alias("__text"))

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        t = sent.value
        if _CACHE_OF[0] != fingerprint:
            _CACHE.clear()
            _CACHE_OF[0] = fingerprint
        out: dict[str, list] = {"record_id": [], "mapping": [], "gain": [], "lost": [], "restored": []}
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not v or v.isascii():
                continue
            new, gain, name = repair(v, t)
            lost = v.count("�")
            if name or lost:
                for k, x in zip(out, (i, name or None, gain, lost, new if with_text else None)):
                    out[k].append(x)
        return out

    return map_batches(src, run, "record_id bigint, mapping string, gain double, lost int, restored string")


def from_content(found: DataFrame, files: DataFrame, record_id: str, content: str, filename: str, content_type: str) -> DataFrame:
    """The rows of ``garbled`` with characters taken from the file's own bytes where the text lost some.

    files has record_id (repeated rows count once) and the other columns.  Only rows that lost
    characters meet their files.  A file's bytes are decoded by what they show, not by what its
    type declares; the result counts if it lost fewer characters and agrees with the
    text about it.  Such rows have the mapping "content".
    """
    found = cut_lineage(found)  # read twice below
    wanted = found.where("lost > 0 and record_id is not null").select("record_id").distinct()
    own = files.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(content).cast("binary").alias("__b"), F.col(filename).cast("string").alias("__n"), F.col(content_type).cast("string").alias("__t"))
    # Only files that are asked for move: few ids are sent to them, many meet them in a join.
    own = own.join(F.broadcast(wanted) if wanted.count() <= MOST_SENT else wanted, "record_id", "left_semi").dropDuplicates(["record_id"])
    hurt = found.where("lost > 0").join(own, "record_id", "left")

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        cols = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
        for k, (b, n, t, text) in enumerate(zip(cols["__b"], cols["__n"], cols["__t"], cols["restored"])):
            new = reread(b, n, t, text) if b and text else None
            if new is not None:
                cols["mapping"][k], cols["restored"][k], cols["lost"][k] = "content", new, new.count("\ufffd")
        return {n: cols[n] for n in ("record_id", "mapping", "gain", "lost", "restored")}

    return found.where("lost = 0").unionByName(map_batches(hurt, run, "record_id bigint, mapping string, gain double, lost int, restored string"))


def reread(content: bytes, filename: str | None, content_type: str | None, text: str) -> str | None:
    """The file's text decoded anew, as far as ``text`` goes; None if it isn't the same text or lost as much."""
    kind, _ = detect_route(content, filename, content_type)
    if kind not in ("text", "html"):
        return None
    new = decode(content)
    new = html_text(new) if kind == "html" else new
    plain = lambda x: _NON_ASCII.sub("", x).split()
    want, have = plain(text), plain(new)
    if not want or have[: max(1, len(want) - 1)] != want[: max(1, len(want) - 1)] or new.count("\ufffd") >= text.count("\ufffd"):
        return None
    if len(have) > len(want):  # the text was cut as well
        new = new[: [m.end() for m in re.finditer(r"\S+", new)][len(want) - 1]] if len(new.split()) >= len(want) else new
    return new


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = garbled(load(spark, sf_dir, "attachment_results"), "attachment_id", "extraction", with_text=False)
    return found.select(F.col("record_id").alias("attachment_id")).distinct()


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each garbled attachment: the mapping, lost characters that could not be had again, and the text restored."""
    found = garbled(load(spark, sf_dir, "attachment_results"), "attachment_id", "extraction").dropDuplicates(["record_id"])
    found = from_content(found, load(spark, sf_dir, "attachments"), "attachment_id", "content", "filename", "content_type")
    return found.select(F.col("record_id").alias("attachment_id"), "mapping", "lost", "restored")
