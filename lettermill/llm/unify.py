"""Visually identical text with different characters (problem 2).

The values of an Arrow batch that aren't ASCII are one array of code points.  Lookup tables
gather, for each code point, its script, its class and the length and place of its
replacement; lengths become expansion offsets (``repeat`` and a running index), marks are
composed by sorted-pair search on whole arrays, and look-alike letters are mapped where
their word is written in another alphabet.  Strings are touched to enter the array and to
leave it, and, of HTML, to take its tags off.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _html
from ._batch import load, map_batches

TOP = 0x20000
#: Classes of a code point.
PLAIN, STYLED, LIGATURE, MARK, INVISIBLE, SPACE = range(6)
#: Reasons, one bit each.
REASONS = {"styled": 1, "ligature": 2, "decomposed": 4, "invisible": 8, "space": 16, "lookalike": 32}
INVISIBLES = (0x00AD, 0x034F, 0x061C, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF)
SPACES = (0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)
LATIN, CYRILLIC, GREEK, ARMENIAN, CHEROKEE = 1, 2, 3, 4, 5
ALPHABETS = {"LATIN": LATIN, "CYRILLIC": CYRILLIC, "GREEK": GREEK, "ARMENIAN": ARMENIAN, "CHEROKEE": CHEROKEE}
N_SCRIPTS = len(ALPHABETS) + 1
#: Stands for U+0000, which parts values in the array: a code point that no text may hold.
ZERO = "\U0010ffff"
#: Letters of the alphabets that share a shape.
LOOKALIKE = (
    ("AΑА", "BΒВ", "EΕЕ", "ZΖ", "HΗН", "IΙІ", "JЈ", "KΚК", "MΜМ", "NΝ", "OΟО", "PΡР", "CϹС", "SЅ", "TΤТ", "YΥУ", "XΧХ")
    + ("aαа", "cϲс", "eе", "iιі", "jј", "oοо", "pρр", "sѕ", "uυ", "vν", "xχх", "yу", "kκк", "hһ", "dԁ", "qԛ", "wԝ", "gɡ")
    + ("ïї", "ëё")
    + ("oօ", "uս", "hհ", "nո", "gց", "qզ", "jյ", "OՕ", "SՏ", "UՍ", "LԼ")
    + ("AᎪ", "BᏴ", "CᏟ", "DᎠ", "EᎬ", "GᏀ", "HᎻ", "JᎫ", "KᏦ", "LᏞ", "MᎷ", "PᏢ", "SᏚ", "TᎢ", "VᏙ", "WᎳ", "ZᏃ", "RᏒ")
)


@lru_cache(1)
def tables() -> dict[str, np.ndarray]:
    kind, script = np.zeros(TOP, np.uint8), np.zeros(TOP, np.uint8)
    letter, size, place = np.zeros(TOP, bool), np.ones(TOP, np.int32), np.arange(TOP, dtype=np.int32)
    pool: list[int] = list(range(TOP))

    def put(c: int, to: str) -> None:
        size[c], place[c] = len(to), len(pool)
        pool.extend(map(ord, to))

    pairs = {}
    for c in [*range(0x3100), *range(0xA640, 0xA800), *range(0xAB30, 0xAB70), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F1AD)]:
        ch = chr(c)
        cat = unicodedata.category(ch)
        letter[c] = cat[0] == "L"
        if cat[0] == "L":
            name = unicodedata.name(ch, "")
            script[c] = ALPHABETS.get(name.split(" ", 1)[0], 0) if c > 0x36F or name.startswith("LATIN") else 0
        if cat in ("Mn", "Mc"):
            kind[c] = MARK
        deco = unicodedata.decomposition(ch)
        if deco.startswith(("<font>", "<wide>")):
            to = unicodedata.normalize("NFKC", ch)
            put(c, to)
            if to.isalpha():
                kind[c] = STYLED
                script[c] = script[ord(to)] if len(to) == 1 and ord(to) < c else LATIN
        elif 0xFB00 <= c <= 0xFB17 or c in (0x132, 0x133, 0x1C4, 0x1C5, 0x1C6, 0x1C7, 0x1C8, 0x1C9, 0x1CA, 0x1CB, 0x1CC):
            to = unicodedata.normalize("NFKC", ch)
            if to != ch:
                kind[c] = LIGATURE
                put(c, to)
        elif deco.startswith("<narrow>") or deco and deco[0] != "<" and " " not in deco:
            put(c, unicodedata.normalize("NFKC", ch))  # half-width forms, and signs that are another letter by definition
        elif deco and deco[0] != "<" and " " in deco and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in deco.split())
            pairs[a << 21 | b] = c
    for c in INVISIBLES:
        kind[c], size[c], script[c], letter[c] = INVISIBLE, 0, 0, False
    for c in SPACES:
        kind[c] = SPACE
        put(c, " ")
    alike = np.zeros((N_SCRIPTS, TOP), np.int32)
    for group in LOOKALIKE:
        for a in group:
            for b in group:
                if a != b and script[ord(b)] != script[ord(a)]:
                    alike[script[ord(b)], ord(a)] = ord(b)
    keys = np.array(sorted(pairs), np.int64)
    notable = (kind > 0) | (script > LATIN) | (place != np.arange(TOP))
    return {"notable": notable, "shared": alike.any(0), "kind": kind, "script": script, "letter": letter, "size": size, "place": place, "pool": np.array(pool, np.int32), "alike": alike, "keys": keys, "made": np.array([pairs[k] for k in keys.tolist()], np.int32)}


def code_points(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the values, each followed by U+0000, and where each value begins."""
    arr = np.frombuffer("\0".join(values + [""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    lengths = np.fromiter(map(len, values), np.int64, len(values)) + 1
    return arr, np.concatenate([[0], np.cumsum(lengths)])


def compose(cp: np.ndarray, row: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Composes base letters with their marks, one mark of each base in a pass; rows in which it did so."""
    hit = []
    while len(cp) > 1:
        safe = np.minimum(cp, TOP - 1)
        at = np.flatnonzero(t["kind"][safe[1:]] == MARK)
        if not len(at):
            break
        key = cp[at].astype(np.int64) << 21 | cp[at + 1]
        k = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        ok = t["keys"][k] == key
        at, made = at[ok], t["made"][k[ok]]
        if len(at) > 1:
            keep = np.concatenate([[True], np.diff(at) > 1])
            at, made = at[keep], made[keep]
        if not len(at):
            break
        hit.append(row[at])
        cp = cp.copy()
        cp[at] = made
        stay = np.ones(len(cp), bool)
        stay[at + 1] = False
        cp, row = cp[stay], row[stay]
    return cp, row, np.concatenate(hit) if hit else np.zeros(0, np.int64)


def unify(values: list[str]) -> tuple[list[str], np.ndarray]:
    """The values in one consistent form, and for each the reasons for which it changed."""
    t = tables()
    reasons = np.zeros(len(values), np.int32)
    todo = [i for i, v in enumerate(values) if not v.isascii()]
    out = list(values)
    if not todo:
        return out, reasons
    zeros = {i for i in todo if "\0" in values[i]}
    picked = [values[i].replace("\0", ZERO) if i in zeros else values[i] for i in todo]
    cp, starts = code_points(picked)
    # Values without any code point of note are in the consistent form already.
    some = np.add.reduceat(t["notable"][np.where(cp < TOP, cp, 0xFFFF)], starts[:-1], dtype=np.int64) > 0
    if not some.all():
        cp, todo = cp[np.repeat(some, np.diff(starts))], [k for k, x in zip(todo, some.tolist()) if x]
        starts = np.concatenate([[0], np.cumsum(np.diff(starts)[some])])
        if not todo:
            return out, reasons
    picked = todo
    bits = np.zeros(len(picked), np.int32)
    row = np.repeat(np.arange(len(picked)), np.diff(starts))

    def mark(rows: np.ndarray, why: str) -> None:
        bits[np.unique(rows)] |= REASONS[why]

    safe = np.minimum(cp, TOP - 1)
    safe = np.where(cp >= TOP, 0xFFFF, safe)
    kind = t["kind"][safe]
    mark(row[kind == STYLED], "styled")
    mark(row[kind == LIGATURE], "ligature")
    mark(row[kind == SPACE], "space")
    # An invisible character counts and goes where a word goes on at both sides; elsewhere (emoji, ends) it stays.
    inv = kind == INVISIBLE
    drop = np.zeros(len(cp), bool)
    if inv.any():
        solid = np.flatnonzero(~inv)
        at = np.flatnonzero(inv)
        k = np.searchsorted(solid, at)
        before = solid[np.maximum(k - 1, 0)]
        after = solid[np.minimum(k, len(solid) - 1)]
        wordy = t["letter"][safe] | (kind == MARK) | (kind == STYLED) | (kind == LIGATURE)
        within = wordy[before] & wordy[after] & (k > 0)
        drop[at[within]] = True
        mark(row[at[within]], "invisible")
    size = np.where(cp >= TOP, 1, t["size"][safe])
    size = np.where(inv & ~drop, 1, size)
    place = t["place"][safe]
    ends = np.cumsum(size)
    index = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(place, size)
    new = t["pool"][index]
    big = np.repeat(np.where(cp >= TOP, cp, 0), size)
    new = np.where(big > 0, big, new).astype(np.int32)
    row = np.repeat(row, size)
    new, row, done = compose(new, row, t)
    mark(done, "decomposed")
    # Look-alikes: a word of letters of two alphabets takes its larger one.
    safe = np.where(new >= TOP, 0, new)
    script = t["script"][safe].astype(np.int64)
    inside = t["letter"][safe] | (t["kind"][safe] == MARK)
    if (script > LATIN).any() and (script == LATIN).any():
        begin = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        word = np.cumsum(inside & ~np.concatenate([[False], inside[:-1]])) - 1
        at = np.flatnonzero(inside & (script > 0))
        counts = np.bincount(word[at] * N_SCRIPTS + script[at], minlength=N_SCRIPTS * len(begin)).reshape(-1, N_SCRIPTS)
        mixed = (counts > 0).sum(1) > 1
        if mixed.any():
            # The word's own alphabet has the letters that no other alphabet shares; else it has most letters, Latin first.
            alone = at[~t["shared"][safe[at]]]
            own = np.bincount(word[alone] * N_SCRIPTS + script[alone], minlength=N_SCRIPTS * len(begin)).reshape(-1, N_SCRIPTS)
            main = (own * 1_000_000 + counts * N_SCRIPTS + np.array([0, *range(N_SCRIPTS - 1, 0, -1)])).argmax(1)
            # Two letters alone, as in units, are no word, and one letter of another alphabet with Latin ones may be a formula's.
            every = np.arange(len(counts))
            mixed &= (counts.sum(1) > 2) & ((counts[every, main] > 1) | (main == LATIN) & (own[every, main] > 0))
            at = at[mixed[word[at]]]
            at = at[script[at] != main[word[at]]]
            to = t["alike"][main[word[at]], safe[at]]
            fit = to > 0
            mark(row[at[fit]], "lookalike")
            new[at[fit]] = to[fit]
    text = new.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split("\0")
    for i, k in enumerate(todo):
        out[k] = text[i].replace(ZERO, "\0") if k in zeros else text[i]
    reasons[todo] = bits
    return out, reasons


def consistent_form(df: DataFrame, record_id: str, fields: dict[str, bool], only_changed: bool = False) -> DataFrame:
    """One row per value: field, record_id, value in one consistent form, reasons.

    fields: column name to whether it is HTML (then its visible text is unified).
    Null values give no row, empty ones an empty form, repeated rows repeated
    rows; other columns are ignored, whatever their names.
    """
    src = df.select(F.col(record_id).cast("bigint").alias("__id"), *[F.col(f).cast("string").alias(f) for f in fields])

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        ids = batch.column(0).to_pylist()
        out: dict[str, list] = {"field": [], "record_id": [], "form": [], "reasons": []}
        for k, (name, markup) in enumerate(fields.items(), 1):
            col = batch.column(k).to_pylist()
            rows = [i for i, v in enumerate(col) if v is not None]
            values = [_html.render(col[i]) if markup and ("&" in col[i] or not col[i].isascii()) else col[i] for i in rows]
            if markup and not only_changed:
                values = [_html.render(v) if v is col[i] else v for i, v in zip(rows, values)]
            form, why = unify(values)
            for j, i in enumerate(rows):
                if why[j] or not only_changed:
                    out["field"].append(name)
                    out["record_id"].append(ids[i])
                    out["form"].append(form[j])
                    out["reasons"].append(int(why[j]))
        return out

    return map_batches(src, run, "field string, record_id bigint, form string, reasons int")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = consistent_form(load(spark, sf_dir, "messages"), "message_id", {"text": False, "html": True}, only_changed=True)
    return found.where("reasons > 0").select("field", F.col("record_id").alias("message_id")).distinct()


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of each text and html body, and its hash: equal-looking bodies have the same."""
    form = consistent_form(load(spark, sf_dir, "messages"), "message_id", {"text": False, "html": True})
    form = form.select("field", F.col("record_id").alias("message_id"), F.xxhash64("form").alias("form_hash"), "form", "reasons")
    return form.dropDuplicates(["field", "message_id", "form_hash", "reasons"])  # a repeated delivery is the same body


def found_sql() -> str:
    """``p2_found`` over the table messages, by patterns over whole values."""
    cls = lambda codes: "".join(f"\\x{{{c:X}}}" for c in codes)
    font = [c for c in range(0x2100, 0x2150) if unicodedata.decomposition(chr(c)).startswith("<font>") and unicodedata.normalize("NFKC", chr(c)).isalpha()]
    styled = cls(font) + r"\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{1D400}-\x{1D6C0}\x{1D6C2}-\x{1D6DA}\x{1D6DC}-\x{1D6FA}\x{1D6FC}-\x{1D7CB}"
    ligature = r"\x{FB00}-\x{FB06}\x{FB13}-\x{FB17}\x{132}\x{133}\x{1C4}-\x{1CC}"
    named = {"nbsp": 0xA0, "shy": 0xAD, "zwnj": 0x200C, "zwj": 0x200D, "ensp": 0x2002, "emsp": 0x2003, "thinsp": 0x2009, "lt": 60, "gt": 62, "amp": 38, "quot": 34}
    told = "CASE " + " ".join(f"WHEN x = '&{n};' THEN chr({c})" for n, c in named.items()) + r" WHEN regexp_matches(x, '^&#[0-9]+;$') THEN chr(CAST(substr(x, 3, length(x) - 3) AS INTEGER)) WHEN regexp_matches(x, '^&#[xX][0-9A-Fa-f]+;$') THEN chr(CAST('0x' || substr(x, 4, length(x) - 4) AS INTEGER)) ELSE x END"
    shown = rf"array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(html, '<!--.*?-->|<(style|script|title)\b.*?</(style|script|title)\s*>', '', 'gis'), '</?[A-Za-z][^<>]*>', ' ', 'g'), '&#?[A-Za-z0-9]+;|[^&]+|&'), lambda x: {told}), '')"
    return rf"""
WITH seen AS (SELECT 'text' AS field, message_id, text AS v FROM messages WHERE text IS NOT NULL UNION ALL SELECT 'html', message_id, {shown} FROM messages WHERE html IS NOT NULL),
plain AS (SELECT *, regexp_replace(v, '([\p{{L}}\p{{M}}])[{cls(INVISIBLES)}]+([\p{{L}}\p{{M}}])', '\1\2', 'g') AS w FROM seen)
SELECT DISTINCT field, message_id FROM plain
WHERE regexp_matches(v, '[{styled}{ligature}{cls(SPACES)}]') OR w <> v OR nfc_normalize(w) <> w
  OR len(list_filter(regexp_extract_all(nfc_normalize(w), '[\p{{L}}\p{{M}}]{{3,}}'), lambda x: regexp_matches(x, '\p{{Latin}}') AND regexp_matches(x, '[\p{{Cyrillic}}\p{{Greek}}]') OR regexp_matches(x, '\p{{Cyrillic}}') AND regexp_matches(x, '\p{{Greek}}'))) > 0"""
