"""Evaluation texts leaking into training text (problem 8).

Words are canonicalised to templates: numbers, units and names become typed
placeholders, the other words of the evaluation items stay themselves.  Windows
of ``WINDOW`` canonical words are joined by hash with those of the items; in each
hit the slot values are compared.  Equal values anchor a verbatim leak, as do windows
without slots that one passage alone has, where it has a run's length of words without
any.  Windows in a row
whose values differ tell a re-parameterised item, if the item's values and the page's
map one to one all over the run.
Where too much is misread for a whole window, a slot value but for one letter anchors
with any two of the ``REACH`` words on each side of it read without error.
Anchors of a page and an item are then extended word by word in the order of the
printed column, forgiving misread letters, broken words, and lines that come in
between; the longest run of the item's words found on the page decides.

The items are few and bounded (``MAX_ITEM_WORDS``, checked); their windows go to
every task and pages never leave theirs, so nothing is shuffled.  Larger item
sets are taken in parts of that size, one pass over the pages each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batch import load, map_batches

WINDOW, RUN, MAX_ITEM_WORDS = 7, 20, 2_000_000
LEAST_VALUES = 4
#: Words on each side of a slot, of which any two anchor it, and the bits of a table that tells most other pairs apart.
REACH, BITS = 3, 22
_SIDES = np.array([d for d in range(-REACH, REACH + 1) if d])
_FIRST, _SECOND = np.triu_indices(len(_SIDES), 1)
NAME, NUMBER, UNIT, OTHER = 1, 2, 3, 4
FIRST = 5
#: Units that follow numbers.
UNITS = frozenset("pounds shillings pence persons miles acres yards feet tons francs mark personen kilomètres kilometer mètres personnes habitants metres hours minutes stunden heures kg km m cm".split())
_SEGMENT = re.compile(r"\t+|\s*\|\s+|\s{3,}")
_BREAK = "-¬‐=­"
_KEEP = re.compile(r"[^\W_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def normal(word: str) -> str:
    return "".join(_KEEP.findall(word)).casefold()


def segments(line: str) -> list[str]:
    return [s for s in _SEGMENT.split(line) if s.strip()] if "\t" in line or "|" in line or "   " in line else [line]


def columns(lines: list[str], x0: list[int] | None) -> list[str]:
    """The page's lines in the order of its printed columns: lines that join two columns are parted."""
    parts = [segments(x) for x in lines]
    starts = np.zeros(0)
    if x0 is not None and len(x0) == len(lines) and len(lines) > 3:
        xs = np.sort(np.asarray(x0, np.float64))
        starts = ((xs[1:] + xs[:-1]) / 2)[np.diff(xs) > 150]
    at = np.searchsorted(starts, np.asarray(x0)).tolist() if len(starts) else [0] * len(lines)
    out: list[list[str]] = [[]]
    for k, p in zip(at, parts):
        for n, x in enumerate(p):
            while len(out) <= k + n:
                out.append([])
            out[k + n].append(x)
    return [x for column in out for x in column]


def stream(text: str, x0: list[int] | None = None) -> list[str]:
    """The page's words as printed, words broken over lines joined."""
    words: list[str] = []
    carry = ""
    for line in columns(text.split("\n"), x0):
        own = line.split()
        if not own:
            continue
        if carry:
            if own[0][:1].islower() or not own[0][:1].isalpha():
                own[0] = carry + own[0]
            else:
                words.append(carry)
            carry = ""
        if own[-1][-1] in _BREAK and len(own[-1]) > 1:
            carry = own.pop()[:-1]
        words += own
    if carry:
        words.append(carry)
    return words


def alike(a: str, b: str) -> bool:
    """Equal but for misread letters."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if a.isdigit() and b.isdigit():
        return False
    if n > m:
        a, b, n, m = b, a, m, n
    if n < 2 or m - n > 2 or (m - n == 2 and m < 7):
        return n == m == 1 and not (a.isdigit() and b.isdigit())
    may = max(1, m // 3)
    if n == m:
        return sum(x != y for x, y in zip(a, b)) <= may
    p = 0
    while p < n and a[p] == b[p]:
        p += 1
    s = 0
    while s < n - p and a[n - 1 - s] == b[m - 1 - s]:
        s += 1
    return m - p - s <= max(may, 2)


def close(a: str, b: str) -> bool:
    """Equal but for one letter: names made of the same parts differ by two."""
    if a == b:
        return True
    if a.isdigit() and b.isdigit() or max(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p:] == b[p + 1 :]


@dataclass
class Index:
    """The items' words, and their windows sorted by hash."""

    ids: np.ndarray
    words: list[list[str]]
    slots: list[list[bool]]
    vocab: dict[str, int]
    names: dict[str, int]
    keys: np.ndarray
    item: np.ndarray
    at: np.ndarray
    values: np.ndarray
    pairs: np.ndarray
    pair_item: np.ndarray
    pair_at: np.ndarray
    pair_bits: np.ndarray
    pair_size: np.ndarray
    maybe: np.ndarray


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which letters each word has, as bits, and its length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    bits = np.uint64(1) << (cp & np.uint64(63))
    return np.bitwise_or.reduceat(bits, np.cumsum(size) - size) if len(words) else bits, size


def pair_keys(canon: np.ndarray, value: np.ndarray, at: np.ndarray, n_vocab: int, n_names: int) -> np.ndarray:
    """For each place, a key of every two words about it that are read as in an item; -1 where they aren't."""
    word = np.where((canon >= FIRST) | (canon == UNIT), canon, np.where(value > 0, FIRST + n_vocab + value, -1))
    side = np.pad(word, REACH, constant_values=-1)[at[:, None] + REACH + _SIDES]
    a, b = side[:, _FIRST], side[:, _SECOND]
    return np.where((a >= 0) & (b >= 0), (a * (FIRST + n_vocab + n_names + 1) + b) * len(_FIRST) + np.arange(len(_FIRST)), -1)


def table_place(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * _MULT) >> np.uint64(64 - BITS)).astype(np.int64)


def window_hash(canon: np.ndarray) -> np.ndarray:
    """Hashes of all windows of WINDOW canonical words."""
    n = len(canon) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = (h ^ canon[k : k + n].astype(np.uint64)) * _MULT
        h ^= h >> np.uint64(29)
    return h


def plain_stretch(value: np.ndarray) -> np.ndarray:
    """Of each window, whether it lies in RUN words or more without a slot: no window with a slot stands for those."""
    slot = np.concatenate([[-1], np.flatnonzero(value > 0), [len(value)]])
    at = np.arange(len(value) - WINDOW + 1)
    k = np.searchsorted(slot, at, "right")
    return (slot[k] - slot[k - 1] > RUN) & (at + WINDOW <= slot[k])


def build(items: list[tuple[int, str]]) -> Index:
    raw = [[w for w in p.split() if normal(w)] for _, p in items]
    norm = [[normal(w) for w in r] for r in raw]
    lower: set[str] = set()
    spread: dict[str, int] = {}
    for r, n in zip(raw, norm):
        for w in set(n):
            spread[w] = spread.get(w, 0) + 1
        lower |= {x for w, x in zip(r, n) if w[:1].islower()}
    # A name is always written with a capital and stands in few items; a title, month or place of the template in many.
    few = max(3, len(items) // 25)
    vocab: dict[str, int] = {}
    names: dict[str, int] = {}
    keys, item, at, values, slots, coded = [], [], [], [], [], []
    for k, (r, n) in enumerate(zip(raw, norm)):
        canon = np.zeros(len(n), np.int64)
        value = np.zeros(len(n), np.int64)
        for i, (w, x) in enumerate(zip(r, n)):
            if x.isdigit():
                canon[i], value[i] = NUMBER, names.setdefault(x, len(names) + 1)
            elif x in UNITS:
                canon[i] = UNIT
            elif x not in lower and w[:1].isupper() and spread[x] <= few and len(x) > 3:
                canon[i], value[i] = NAME, names.setdefault(x, len(names) + 1)
            else:
                canon[i] = vocab.setdefault(x, FIRST + len(vocab))
        slots.append((value > 0).tolist())
        coded.append((canon, value))
    # A window without slots that several passages share is of their template, and tells none of them.
    text_of: dict[tuple[str, ...], int] = {}
    same = [text_of.setdefault(tuple(n), k) for k, n in enumerate(norm)]
    hashes = [window_hash(canon) for canon, _ in coded]
    every = np.concatenate([np.zeros(0, np.uint64), *hashes])
    owner = np.repeat(np.array(same, np.int64), [len(h) for h in hashes])
    by = np.lexsort((owner, every))
    every, owner = every[by], owner[by]
    common = np.unique(every[1:][(every[1:] == every[:-1]) & (owner[1:] != owner[:-1])])
    for k, (h, (_, value)) in enumerate(zip(hashes, coded)):
        if len(h):
            v = np.lib.stride_tricks.sliding_window_view(value, WINDOW)
            some = np.flatnonzero(((v > 0).sum(1) > 0) & ((v == 0).sum(1) > 2) | plain_stretch(value) & ~np.isin(h, common))
            keys.append(h[some])
            item.append(np.full(len(some), k))
            at.append(some)
            values.append(v[some])
    z = np.zeros(0, np.int64)
    pairs, pair_item, pair_at = [z], [z], [z]
    for k, (canon, value) in enumerate(coded):
        some = np.flatnonzero(value > 0)
        key = pair_keys(canon, value, some, len(vocab), len(names))
        row, col = np.nonzero(key >= 0)
        pairs.append(key[row, col])
        pair_item.append(np.full(len(row), k))
        pair_at.append(some[row])
    pair = np.concatenate(pairs)
    by = np.argsort(pair, kind="stable")
    maybe = np.zeros(1 << BITS, bool)
    maybe[table_place(pair)] = True
    pair_item, pair_at = np.concatenate(pair_item)[by], np.concatenate(pair_at)[by]
    near = (pair[by], pair_item, pair_at, *letters([norm[k][i] for k, i in zip(pair_item.tolist(), pair_at.tolist())]), maybe)
    if not keys:
        return Index(np.array([i for i, _ in items]), norm, slots, vocab, names, np.zeros(0, np.uint64), z, z, np.zeros((0, WINDOW), np.int64), *near)
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    return Index(np.array([i for i, _ in items]), norm, slots, vocab, names, key[order], np.concatenate(item)[order], np.concatenate(at)[order], np.concatenate(values)[order], *near)


def canonical(words: list[str], norm: list[str], ix: Index) -> tuple[np.ndarray, np.ndarray]:
    """Canonical words of a page, and its slot values: the item name of that spelling, or -1 for another."""
    canon, value = [], []
    vocab, names = ix.vocab.get, ix.names.get
    for w, x in zip(words, norm):
        c = vocab(x)
        if c is not None:
            canon.append(c)
            value.append(0)
        elif x in UNITS:
            canon.append(UNIT)
            value.append(0)
        elif x.isdigit():
            canon.append(NUMBER)
            value.append(names(x, -1))
        elif w[:1].isupper() and len(x) > 3:
            canon.append(NAME)
            value.append(names(x, -1))
        else:
            canon.append(OTHER)
            value.append(0)
    return np.array(canon, np.int64), np.array(value, np.int64)


def join_windows(canon: np.ndarray, value: np.ndarray, ix: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place on page, row of the index, 1 slots agree / 0 they don't) for each window that is an item's template."""
    h = window_hash(canon)
    lo = np.searchsorted(ix.keys, h, "left")
    n = np.searchsorted(ix.keys, h, "right") - lo
    total = int(n.sum())
    if not total:
        z = np.zeros(0, np.int64)
        return z, z, z
    page = np.repeat(np.arange(len(h)), n)
    row = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    want = ix.values[row]
    have = value[page[:, None] + np.arange(WINDOW)]
    slot = want > 0
    same = ((want == have) & slot).sum(1)
    wrong = ((want != have) & slot & (have > 0)).sum(1)  # another item's name; a spelling unknown to all may be misread
    return page, row, (((same > 0) | ~slot.any(1)) & (wrong == 0)).astype(np.int64)


def reparameterised(norm: list[str], page: np.ndarray, row: np.ndarray, ix: Index) -> dict[int, int]:
    """By item, the longest run of template windows whose slots hold other values, mapped one to one.

    Windows in line (of one item, at one distance between page and item, overlapping) make a run.
    A run tells a re-parameterised item if it has RUN words and LEAST_VALUES different values of the
    item, as single sentences of one template are common, none of them kept, each always replaced
    alike and no two by the same word.
    """
    out: dict[int, int] = {}
    if not len(page):
        return out
    item, at = ix.item[row], ix.at[row]
    order = np.lexsort((page, page - at, item))
    item, at, page = item[order], at[order], page[order]
    new = np.concatenate([[True], (item[1:] != item[:-1]) | (np.diff(page - at) != 0) | (np.diff(page) > WINDOW)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    size = page[last] - page[first] + WINDOW
    for f, n in zip(first[size >= RUN].tolist(), size[size >= RUN].tolist()):
        k, i, j = int(item[f]), int(page[f]), int(at[f])
        put: dict[str, str] = {}
        slots = [d for d in range(n) if ix.slots[k][j + d]]
        fits = all(put.setdefault(ix.words[k][j + d], norm[i + d]) == norm[i + d] for d in slots)
        if fits and len(put) >= LEAST_VALUES and len(set(put.values())) == len(put) and not any(alike(a, b) for a, b in put.items()):
            out[k] = max(out.get(k, 0), n)
    return out


def join_slots(norm: list[str], canon: np.ndarray, value: np.ndarray, ix: Index) -> dict[int, list[tuple[int, int]]]:
    """By item, (place on page, place in item) of words that are close to a slot's value and have two of its neighbours."""
    out: dict[int, list[tuple[int, int]]] = {}
    at = np.flatnonzero((canon < FIRST) & (canon != UNIT))
    if not len(at) or not len(ix.pairs):
        return out
    key = pair_keys(canon, value, at, len(ix.vocab), len(ix.names))
    row, col = np.nonzero((key >= 0) & ix.maybe[table_place(key)])
    key = key[row, col]
    lo = np.searchsorted(ix.pairs, key, "left")
    n = np.searchsorted(ix.pairs, key, "right") - lo
    total = int(n.sum())
    if not total:
        return out
    k = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    # What close() wants of lengths and letters.
    bits, size = letters([norm[i] for i in at.tolist()])
    of = np.repeat(row, n)
    may = (np.abs(size[of] - ix.pair_size[k]) <= 1) & (np.bitwise_count(bits[of] ^ ix.pair_bits[k]) <= 2)
    k, of = k[may], of[may]
    found = {*zip(ix.pair_item[k].tolist(), at[of].tolist(), ix.pair_at[k].tolist())}
    for item, i, j in sorted(found):
        a, b = norm[i], ix.words[item][j]
        if close(a, b):
            out.setdefault(item, []).append((i, j))
    return out


def extend(page: list[str], item: list[str], slot: list[bool], i: int, j: int, step: int, seen: bytearray) -> tuple[int, int]:
    """Goes on from page word i and item word j; marks the item's words in ``seen``."""
    n, m = len(page), len(item)
    while 0 <= i < n and 0 <= j < m:
        if alike(page[i], item[j]):
            seen[j] = 1
            i += step
            j += step
            continue
        for a, b in ((1, 1), (2, 1), (1, 0), (1, 2), (0, 1), (2, 2), (3, 1), (3, 2)):
            x, y = i + step * a, j + step * b
            if 0 <= x < n and 0 <= y < m and alike(page[x], item[y]) and (not 0 <= x + step < n or not 0 <= y + step < m or alike(page[x + step], item[y + step])):
                over = [j + step * k for k in range(b)]
                if any(slot[k] for k in over):
                    # A slot is passed over only where its pieces stand there.
                    got = "".join(page[i + step * k] for k in (range(a) if step > 0 else range(a - 1, -1, -1)))
                    if not alike(got, "".join(item[k] for k in sorted(over))):
                        continue
                for k in over:
                    seen[k] = 1
                i, j = x, y
                break
        else:
            break
    return i, j


def longest(seen: bytearray, slot: list[bool]) -> int:
    """Longest run of marked words; one or two template words missing between marked ones don't end it."""
    best = run = gap = 0
    for j, s in enumerate(seen):
        if s:
            run += gap + 1
            gap = 0
            best = max(best, run)
        elif run and gap < 2 and not slot[j]:
            gap += 1
        else:
            run = gap = 0
    return best


def leaks(text: str, x0: list[int] | None, ix: Index) -> list[tuple[int, str, int, int, int]]:
    """(item id, verbatim or reparameterised, longest run, template windows hit, windows hit with equal slots) of the page."""
    words = [w for w in stream(text, x0)]
    norm = [normal(w) for w in words]
    if "" in norm:
        words = [w for w, x in zip(words, norm) if x]
        norm = [x for x in norm if x]
    canon, value = canonical(words, norm, ix)
    page, row, equal = join_windows(canon, value, ix)
    near = join_slots(norm, canon, value, ix)
    if not len(page) and not near:
        return []
    item = ix.item[row]
    n_hit = np.bincount(item, minlength=len(ix.ids))
    n_equal = np.bincount(item, equal, len(ix.ids)).astype(np.int64)
    out = []
    for k in sorted({*np.flatnonzero(n_equal).tolist(), *near}):
        own, slot = ix.words[k], ix.slots[k]
        seen = bytearray(len(own))
        for a, r in zip(page[(item == k) & (equal == 1)].tolist(), row[(item == k) & (equal == 1)].tolist()) if n_equal[k] else ():
            j = int(ix.at[r])
            if all(seen[j : j + WINDOW]):
                continue
            extend(norm, own, slot, a, j, 1, seen)
            extend(norm, own, slot, a, j, -1, seen)
        done: list[tuple[int, int, int, int]] = []
        for a, j in near.get(k, ()):
            if seen[j] or any(x <= a <= y and u <= j <= v for x, y, u, v in done):
                continue
            part = bytearray(len(own))
            y, v = extend(norm, own, slot, a, j, 1, part)
            x, u = extend(norm, own, slot, a, j, -1, part)
            done.append((x, y, u, v))
            # As many words as a window has: a slot and its neighbours alone may be alike by chance.
            if part.count(1) >= WINDOW:
                seen = bytearray(map(max, seen, part))
        run = longest(seen, slot)
        if run >= WINDOW or n_equal[k]:
            out.append((int(ix.ids[k]), "verbatim", run, int(n_hit[k]), int(n_equal[k])))
    whole = {i for i, _, run, _, _ in out if run >= RUN}
    for k, run in reparameterised(norm, page, row, ix).items():
        if int(ix.ids[k]) not in whole:
            out.append((int(ix.ids[k]), "reparameterised", run, int(n_hit[k]), int(n_equal[k])))
    return out


def leaked(pages: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, passage: str, boxes: str | None = None, least: int = 1) -> DataFrame:
    """doc_id, item_id, kind, run, n_template, n_equal for each page and item that share a run of ``least`` words, verbatim or but for its slots.

    Null and empty texts and passages give no row, repeated rows repeated rows;
    other columns are ignored.  boxes: array of structs with x0, one a line.
    """
    spark = pages.sparkSession
    wanted = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(passage).cast("string").alias("p")).where("p is not null and i is not null").dropDuplicates(["i"]).withColumn("n", F.size(F.split("p", r"\s+")))
    total = wanted.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-int(total) // MAX_ITEM_WORDS))
    src = pages.select(F.col(doc_id).cast("bigint").alias("__id"), F.col(text).cast("string").alias("__text"), (F.transform(F.col(boxes), lambda b: b["x0"].cast("int")) if boxes else F.lit(None).cast("array<int>")).alias("__x0")).where("__text is not null")
    out = None
    for k in range(parts):
        part = wanted.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == k) if parts > 1 else wanted
        sent = spark.sparkContext.broadcast(build([(r["i"], r["p"]) for r in part.orderBy("i").collect()]))  # MAX_ITEM_WORDS words or so

        def run(batch: pa.RecordBatch, sent=sent) -> dict[str, list]:
            ix = sent.value
            res: dict[str, list] = {c: [] for c in ("doc_id", "item_id", "kind", "run", "n_template", "n_equal")}
            for i, t, x0 in zip(*(batch.column(c).to_pylist() for c in range(3))):
                for item, kind, n, hit, equal in leaks(t, x0, ix):
                    if n >= least:
                        for c, v in zip(res, (i, item, kind, n, hit, equal)):
                            res[c].append(v)
            return res

        one = map_batches(src, run, "doc_id bigint, item_id bigint, kind string, run int, n_template int, n_equal int")
        out = one if out is None else out.unionByName(one)
    return out


def _of(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    return leaked(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "passage", "line_boxes", least)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, RUN).where("kind = 'verbatim'").select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each leaked item: pages that hold it verbatim, the longest run, and pages that hold it with other names and numbers."""
    own = F.col("kind") == "verbatim"
    runs = _of(spark, sf_dir, RUN).groupBy("item_id")
    return runs.agg(F.countDistinct(F.when(own, F.col("doc_id"))).alias("n_pages"), F.max(F.when(own, F.col("run"))).alias("longest_run"), F.countDistinct(F.when(~own, F.col("doc_id"))).alias("n_reparameterised"))
