"""Personal information inside free text (problem 4).

Scanners propose spans.  A skip-chain conditional random field over the spans of
each document decides their labels: node potentials from the span's form, the
words about it and a name lexicon; chain potentials between neighbours; skip
potentials between distant spans that are equal, or share a name with each other
or with an address local part.  Loopy belief propagation passes messages over all
documents of a batch at once, as arrays over edges.

The lexicon is learned from the corpus: names before a bracketed address whose
local part has the family name, counted exactly.  It goes to the tasks as sorted
64-bit hashes, up to ``MOST_NAMES`` of them; beyond that as a table of ``PLACES``
bits.  A pair of capitalised words that the lexicon doesn't know is a candidate as
well where an address of the text has one of them: there only the skip edge decides.

Potentials of nodes are set by hand, as there are no labels.  Those of edges are
fitted to the corpus: over all its texts, beliefs under the potentials set by hand
give the joint frequency of labels at the ends of each kind of edge, and its logarithm
over that of independent labels replaces them, shrunk by ``SHRINK``.  The tasks add
frequencies up in whole units, so that their order and the partitions don't matter.
Every edge counts, but together they weigh ``WEIGHT`` at most: node potentials are made
for edges of that strength, and a corpus repeated ten times has the same potentials.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batch import load, map_batches

LABELS = ("none", "email", "phone", "idno", "address", "name")
NONE, EMAIL, PHONE, IDNO, ADDRESS, PERSON = range(6)
ROUNDS = 6
#: Names that go to the tasks as hashes (8 bytes each), and bits of the table that is sent where there are more.
MOST_NAMES, PLACES = 1 << 23, 1 << 28
#: The weight, in edges, of the potentials set by hand, and the most that all edges of a kind have against it; the units of an edge in which frequencies of labels are added.
SHRINK, WEIGHT, UNIT = 200.0, 2_000.0, 1 << 24

_W = r"[A-ZÀ-ÖØ-ÞĄĆĘŁŃÓŚŹŻА-ЯЁ][\w'’-]+"
SCANNERS: list[tuple[int, re.Pattern]] = [
    (EMAIL, re.compile(r"[\w.+-]+(?:\s*[\[({]dot[\])}]\s*[\w+-]+)*\s*[\[({](?:at|@)[\])}]\s*[\w-]+(?:\s*(?:[\[({]dot[\])}]|\.)\s*[\w-]+)+", re.I)),
    (EMAIL, re.compile(r"\b[\w+-]+(?: +dot +[\w+-]+)* +at +[\w-]+(?: +dot +[\w-]+)+", re.I)),
    (IDNO, re.compile(r"\b[A-Z]{2}\d{2}(?: {0,4}\d{4}){3,7}(?: {0,4}\d{1,4})?\b")),
    (IDNO, re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    (IDNO, re.compile(r"(?<![\w-])(?:[A-Z]\d[A-Z]\d{6}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]{1,3}\d{6,9}[A-Z]?|\d{8}[A-Z])(?![\w-])")),
    (IDNO, re.compile(r"(?<![\w.,/+-])\d{10,13}(?![\w/-])")),
    (PHONE, re.compile(r"(?<![\w+.,-])(?:\+|00)\d(?:(?:[./-]| {0,4})(?:\(0\))?(?:[./-]| {0,4})\d){7,14}(?!\w)")),
    (PHONE, re.compile(r"(?<![\w+])\(\d{3}\)(?:-| {0,4})\d{3}(?:[-.]| {1,4})\d{4}(?!\w)")),
    (PHONE, re.compile(r"(?<![\w.+-])\d{3}([-.])\d{3}\1\d{4}(?![\w-])")),
    (PHONE, re.compile(r"(?<![\w+.,/-])0(?!\d\d-\d\d-\d{4}\b)\d{1,4}(?:(?:[./-]| {0,4})\d){6,10}(?!\w)")),
    (ADDRESS, re.compile(rf"(?<![\w-])\d{{1,4}}[a-z]?,? +(?:{_W} +){{1,3}}?(?:Street|Road|Lane|Avenue|Close|Drive|Court|Way|Square|Terrace|Place|Boulevard|Crescent|Gardens|St|Rd|Ave|Ln|Blvd|Dr)\b\.?")),
    (ADDRESS, re.compile(r"\b[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|damm|ufer|chaussee) +\d{1,4} ?[a-z]?\b")),
    (ADDRESS, re.compile(rf"(?<![\w-])\d{{1,4}}(?: ?(?:bis|ter|quater|[a-c]))?,? +(?:rue|avenue|boulevard|place|chemin|quai|impasse|allée|route|cours) +(?:(?:de +la|de +l['’]|des|du|de|d['’]) *)?{_W}(?: +{_W})*")),
    (ADDRESS, re.compile(rf"\b(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo|[Cc]amino) +(?:(?:de +las|de +los|de +la|del|de) +)?{_W}(?: +{_W})*,? +(?:n\.?º *)?\d{{1,4}}[a-z]?\b")),
    (ADDRESS, re.compile(rf"\b(?:ul\.|al\.|pl\.|ulica|ул\.|улица|пр\.|проспект|пер\.) *(?:{_W} *){{1,3}},? *(?:д\. *|дом +)?\d{{1,4}}[a-zа-я]?(?:/\d+)?\b")),
]
#: Ends of the German scanner's first word, and words of which the Spanish and the Polish and Russian one need one.
_STREETS = ("straße", "strasse", "str.", "gasse", "weg", "allee", "platz", "ring", "damm", "ufer", "chaussee")
_CALLES, _ULICAS = ("alle ", "venida ", "laza ", "aseo ", "amino "), ("ul.", "al.", "pl.", "ulica", "ул.", "улица", "пр.", "проспект", "пер.")
_DIGITS = re.compile(r"\d\d*")
#: What an address has beside its @, looked for from there outwards.
_LOCAL, _DOMAIN = re.compile(r"[\w.+-]*\w\Z"), re.compile(r"@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}\b")
_AT, _DOT = re.compile(r"[\[({](?:at|@)[\])}]", re.I), re.compile(r" at .{0,80} dot ", re.I)
#: A text with none of these holds no span but perhaps a name.
_HINT = re.compile(r"@|\d|[\[({]at[\])}]| dot ", re.I)
_TOKEN = re.compile(r"[A-ZÀ-ÖØ-ÞĄĆĘŁŃÓŚŹŻА-ЯЁ][^\W\d_]+(?:[-'’][^\W\d_]+)*")
_DATE = re.compile(r"\d{1,2}[./-]\d{1,2}[./-](?:19|20)\d\d|(?:19|20)\d\d[./-]\d{1,2}[./-]\d{1,2}")
#: Words that come before or after spans of a type.
CUES = {
    PHONE: re.compile(r"\b(?:tel|telefon|phone|mobile|mob|cell|fax|ring|call|dial|desk answers|t|m|p|tél|portable|appelez|móvil|llama|teléfono|nummer|rufen|handy|mój telefon|dzwonić|komórka|телефон|звоните)\b|☎", re.I),
    IDNO: re.compile(r"identi|payroll|\bpass(?:port|nummer)?\b|ausweis|kennung|formular|\bform\b|document|pièce|dokument|karty|kartą|номер документа|бланк|iban|\btax\b|\bssn\b|visitor|\bn\.?i\b|konto|compte|account|carte|tarjeta|карте|card|pesel|steuer", re.I),
    NONE: re.compile(r"\b(?:order|invoice|ticket|build|inv|item|lot|ref|auftrag|rechnung|facture|commande|factura|pedido|zamówienie|faktura|заказ|счёт|bestellung|version|room)\b[\s.:#№-]*(?:no\b|nr\b|number\b|numéro\b|nº)?[\s.:#№-]*$", re.I),
}
#: Chain potentials of neighbours: parts of a contact block support each other.
CHAIN = np.zeros((6, 6), np.float32)
for _a in (EMAIL, PHONE, ADDRESS, PERSON):
    for _b in (EMAIL, PHONE, ADDRESS, PERSON):
        CHAIN[_a, _b] = 0.4
SKIP_SAME = np.where(np.eye(6, dtype=bool), 2.0, 0.0).astype(np.float32)
SKIP_NAME = np.zeros((6, 6), np.float32)
SKIP_NAME[PERSON, PERSON] = SKIP_NAME[EMAIL, PERSON] = SKIP_NAME[PERSON, EMAIL] = 1.5


#: Potentials of edges as set by hand, by kind.
HAND = np.stack([CHAIN, SKIP_SAME, SKIP_NAME])


def normal(span: str) -> str:
    return "".join(c for c in span.lower() if c.isalnum())


def token_hash(token: str) -> int:
    """62 bits of a token without case; two more tell given and family names."""
    return xxhash.xxh3_64_intdigest(token.casefold().encode("utf-8", "surrogatepass")) >> 2


class Lexicon:
    """Which tokens are given names (1), family names (2) or both (3), and the fitted potentials of edges."""

    def __init__(self, hashes: np.ndarray, kinds: np.ndarray, table: np.ndarray | None = None) -> None:
        order = np.argsort(hashes, kind="stable")
        self.keys = hashes[order].astype(np.uint64) << np.uint64(2) | kinds[order].astype(np.uint64)
        self.table = table
        self.pair = HAND
        self.known: dict[str, int] = {}

    @classmethod
    def of(cls, given: list[str], family: list[str]) -> Lexicon:
        kinds: dict[int, int] = {}
        for bit, names in ((1, given), (2, family)):
            for n in names:
                kinds[token_hash(n)] = kinds.get(token_hash(n), 0) | bit
        return cls(np.fromiter(kinds, np.uint64, len(kinds)), np.fromiter(kinds.values(), np.uint64, len(kinds)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def kind(self, token: str) -> int:
        hit = self.known.get(token)
        if hit is None:
            h = token_hash(token)
            if self.table is not None:
                at = (h % (len(self.table) << 5)) * 2
                hit = int(self.table[at >> 6] >> np.uint64(at & 63)) & 3
            else:
                k = int(np.searchsorted(self.keys, np.uint64(h << 2)))
                hit = int(self.keys[k]) & 3 if k < len(self.keys) and int(self.keys[k]) >> 2 == h else 0
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[token] = hit
        return hit


_HEADER = re.compile(r"([^\W\d_][\w'’-]+) ([^\W\d_][\w'’-]+)\s*<([^<>@\s]+)@[^<>\s]+>")


def header_names(texts: list[str]) -> dict[tuple[str, int], int]:
    """Counts of (given name, 0) and (family name, 1)."""
    out: dict[tuple[str, int], int] = {}
    for t in texts:
        if "<" not in t:
            continue
        for m in _HEADER.finditer(t):
            given, family, local = m[1].casefold(), m[2].casefold(), m[3].casefold()
            if family in local:
                for k in ((given, 0), (family, 1)):
                    out[k] = out.get(k, 0) + 1
    return out


def lexicon(df: DataFrame, text: str) -> Lexicon:
    """The names of the corpus, and the potentials of edges fitted to all its texts.

    A name counts as given or family name if it stands so twice or more, and in a tenth or more of
    the times of its other use.
    """

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        c = header_names([t for t in batch.column(0).to_pylist() if t])
        return {"h": [token_hash(t) for t, _ in c], "family": [k for _, k in c], "n": list(c.values())}

    src = df.select(F.col(text).cast("string").alias("t"))
    per = map_batches(src, run, "h bigint, family bigint, n bigint").groupBy("h").agg(F.sum(F.when(F.col("family") == 0, F.col("n")).otherwise(0)).alias("g"), F.sum("n").alias("n"))
    f = F.col("n") - F.col("g")
    kind = F.when((F.col("g") >= 2) & (F.col("g") * 10 >= f), 1).otherwise(0) + F.when((f >= 2) & (f * 10 >= F.col("g")), 2).otherwise(0)
    names = per.select("h", kind.alias("kind")).where("kind > 0")
    rows = names.limit(MOST_NAMES + 1).toPandas()
    if len(rows) <= MOST_NAMES:
        lex = Lexicon(rows["h"].to_numpy(np.uint64), rows["kind"].to_numpy(np.uint64))
    else:  # a table whose size doesn't grow: words of 64 bits, two bits a place
        at = F.pmod(F.col("h"), F.lit(PLACES >> 1)) * 2
        words = names.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.col("kind").cast("bigint"), at.bitwiseAND(63).cast("int"))).alias("bits")).toPandas()
        table = np.zeros(PLACES >> 6, np.uint64)
        table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
        lex = Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.uint64), table)
    sent = df.sparkSession.sparkContext.broadcast(lex)

    def count(batch: pa.RecordBatch) -> dict[str, list]:
        sums = edge_sums(batch.column(0).to_pylist(), sent.value).ravel()
        at = sums.nonzero()[0]
        return {"cell": at.tolist(), "n": sums[at].tolist()}

    sums = np.zeros((len(HAND), len(LABELS) ** 2 + 1), np.int64)
    for r in map_batches(src, count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sums.flat[r.cell] = r.n
    sent.destroy()
    lex.pair = fitted(sums)
    return lex


def edge_sums(texts: Iterable[str | None], lex: Lexicon) -> np.ndarray:
    """For each kind of edge: joint frequencies of the labels at its ends in units, row by row, then the number of edges."""
    out = np.zeros((len(HAND), len(LABELS) ** 2 + 1), np.int64)
    s = Spans()
    for i, t in enumerate(texts):
        if t:
            scan(i, t, lex, s)
    if not s.unary:
        return out
    a, b, kind = edges(s)
    belief = propagate(np.array(s.unary, np.float32), a, b, kind, HAND)
    p = np.exp(belief - belief.max(1, keepdims=True)).astype(np.float64)
    p /= p.sum(1, keepdims=True)
    for k in range(len(HAND)):
        at = np.flatnonzero(kind == k)
        out[k, -1] = len(at)
        for x in range(0, len(at), 1 << 14):
            e = at[x : x + (1 << 14)]
            out[k, :-1] += np.rint(p[a[e]][:, :, None] * p[b[e]][:, None, :] * UNIT).astype(np.int64).sum(0).ravel()
    return out


def fitted(sums: np.ndarray) -> np.ndarray:
    """Potentials of the three kinds of edges from sums of ``edge_sums``."""
    out = HAND.copy()
    for k in range(len(HAND)):
        n = min(float(sums[k, -1]), WEIGHT)
        joint = sums[k, :-1].reshape(len(LABELS), -1) * (n / max(sums[k, -1], 1) / UNIT)
        joint = joint + joint.T if k else joint
        total = max(joint.sum(), 1.0)
        alone = joint.sum(1)[:, None] * joint.sum(0)[None, :] / total
        seen = np.log((joint + 1.0) / (alone + 1.0))
        out[k] = (n * np.clip(seen, -1.0, 2.5) + SHRINK * HAND[k]) / (n + SHRINK)
    return out.astype(np.float32)


def fit_edges(texts: list[str], lex: Lexicon) -> np.ndarray:
    """Potentials of the three kinds of edges from beliefs over some texts."""
    return fitted(edge_sums(texts, lex))


def unwrap(text: str) -> str:
    """Line ends within wrapped prose, with the quote marks after them, as spaces; all places stay the same."""
    if "\n" not in text and "\r" not in text:
        return text
    out = []
    prev = 0
    for m in _WRAP.finditer(text):
        line = text[prev : m.start()]
        out.append(line)
        body = line.lstrip("> |\t")
        nxt = text[m.end() : m.end() + 1]
        out.append(" " * len(m[0]) if len(body) >= 46 and m[0].count("\n") + m[0].count("\r") <= 2 and nxt not in ("", "\n", "\r", "-", "*", "|") and "\n\n" not in m[0] and "\r\n\r\n" not in m[0] else m[0])
        prev = m.end()
    out.append(text[prev:])
    return "".join(out)


_SPACES = dict.fromkeys((0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000), " ")
_ODD_SPACE = re.compile("[" + "".join(map(chr, _SPACES)) + "]")
_WRAP = re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:[>|][ \t]?)*")


class Spans:
    """Candidate spans of a batch, with node potentials and the parts that edges are made of."""

    def __init__(self) -> None:
        self.doc: list[int] = []
        self.begin: list[int] = []
        self.end: list[int] = []
        self.text: list[str] = []
        self.unary: list[list[float]] = []
        self.keys: list[str] = []
        self.names: list[tuple[str, ...]] = []

    def add(self, doc: int, a: int, b: int, span: str, unary: list[float], names: tuple[str, ...]) -> None:
        self.doc.append(doc)
        self.begin.append(a)
        self.end.append(b)
        self.text.append(span)
        self.unary.append(unary)
        self.keys.append(normal(span))
        self.names.append(names)


def matches(pattern: re.Pattern, view: str, starts: list[int]) -> Iterator[re.Match]:
    """What ``finditer`` gives; starts, in order, has every place where a match can begin."""
    end = 0
    for p in starts:
        if p >= end and (m := pattern.match(view, p)):
            end = m.end()
            yield m


def scanned(view: str) -> list[tuple[int, int, int]]:
    """Begin, end and label of what each scanner finds.  All but e-mail need digits and are tried about runs of these alone."""
    found = [(m.start(), m.end(), EMAIL) for k, gate in enumerate((_AT, _DOT)) if gate.search(view) for m in SCANNERS[k][1].finditer(view)]
    runs = [m.span() for m in _DIGITS.finditer(view)]
    if not runs:
        return found
    # In the order of SCANNERS, less e-mail; no scanner that begins with digits does so inside a run.
    starts: list[list[int]] = [[] for _ in SCANNERS[2:]]
    iban, tax, code, long, abroad, area, parted, home, english, _, french, _, _ = starts
    german = False
    for p, end in runs:
        n = end - p
        before = view[p - 1] if p else ""
        if n <= 4:
            english.append(p)
            french.append(p)
            if n == 3:
                tax.append(p)
                parted.append(p)
                if before == "(":
                    area.append(p - 1)
        elif n == 8:
            code.append(p)
        elif 10 <= n <= 13:
            long.append(p)
        if "A" <= before <= "Z":
            iban.append(p - 2)
            code += (p - 3, p - 2, p - 1)
        elif before == "+":
            abroad.append(p - 1)
        elif view[p] == "0":
            home.append(p)
            abroad.append(p)
        if before == " ":
            if p > 2 and "A" <= view[p - 2] <= "Z":
                code.append(p - 3)
            if not german:
                q = p - 1
                while q and view[q - 1] == " ":
                    q -= 1
                german = view.endswith(_STREETS, 0, q)
    everywhere = {9: german, 11: any(w in view for w in _CALLES), 12: any(w in view for w in _ULICAS)}
    starts[2] = sorted({p for p in code if p >= 0})
    starts[0] = [p for p in iban if p >= 0]
    for k, (label, pattern) in enumerate(SCANNERS[2:]):
        for m in matches(pattern, view, starts[k]) if k not in everywhere else pattern.finditer(view) if everywhere[k] else ():
            found.append((m.start(), m.end(), label))
    return found


def scan(doc: int, text: str, lex: Lexicon, out: Spans) -> None:
    view = unwrap(text)
    if not view.isascii() and _ODD_SPACE.search(view):
        view = view.translate(_SPACES)
    # Begins and ends of the spans taken, which don't overlap, in order of place; and the node of a begin.
    begins: list[int] = []
    ends: list[int] = []
    node: dict[int, int] = {}
    nodes: list[tuple[int, int, list[float], tuple[str, ...]]] = []
    if _HINT.search(view):
        found = scanned(view)
        at = view.find("@")
        while at >= 0:
            m = _DOMAIN.match(view, at)
            if m and (n := _LOCAL.search(view[max(0, at - 96) : at])):
                found.append((at - len(n[0]), m.end(), EMAIL))
            at = view.find("@", at + 1)
        # Spans that overlap are one node: the longest, with a potential for each label proposed.
        found.sort(key=lambda x: (x[0] - x[1], x[0], x[2]))
        for a, b, label in found:
            at = bisect_left(begins, b)
            if at and ends[at - 1] > a:
                if (begins[at - 1], ends[at - 1]) == (a, b):
                    unary = nodes[node[a]][2]
                    unary[label] = max(unary[label], 1.0)
                continue
            span = view[a:b]
            unary = [0.0, -6.0, -6.0, -6.0, -6.0, -6.0]
            unary[label] = 4.0 if label in (EMAIL, ADDRESS) else 1.2
            n_digits = sum(map(str.isdigit, span))
            if label == PHONE and (n_digits < 9 or n_digits > 15 or _DATE.search(span)):
                continue
            if label in (PHONE, IDNO):
                before, after = view[max(0, a - 44) : a], view[b : b + 36]
                line = before[before.rfind("\n") + 1 :]
                if span.isdigit():
                    # Without a separator: a number abroad has ten digits or more after its 00.
                    phone = span.startswith("0") and (span[1] != "0" or n_digits > 11)
                    unary[PHONE], unary[IDNO] = (1.2, -0.6) if phone else (-1.0, 1.2 if n_digits == 11 else -1.0)
                for k in (PHONE, IDNO):
                    if unary[k] > -2 and (CUES[k].search(line) or (k == IDNO and CUES[k].search(after))):
                        unary[k] += 1.6
                if not line.strip(" >|:.TtMm") and unary[PHONE] > -2:
                    unary[PHONE] += 1.0  # a line of a contact block
                if CUES[NONE].search(line):
                    unary[NONE] += 3.0
            names = tuple(x for x in re.split(r"[\W\d_]+", span[: span.find("@")].casefold()) if len(x) > 3) if label == EMAIL and "@" in span else ()
            begins.insert(at, a)
            ends.insert(at, b)
            node[a] = len(nodes)
            nodes.append((a, b, unary, names))
    mailed = {x for _, _, _, names in nodes for x in names}
    prev = None
    for m in _TOKEN.finditer(view):
        token = m[0]
        kind = lex.kind(token)
        if mailed and token.casefold() in mailed:
            kind |= 4
        if prev is not None and (kind or prev[1]):
            a, b = prev[0], m
            gap = view[a.end() : b.start()]
            if gap == " " or gap == ", " or (gap and gap[0] in " ," and not gap.strip(" ,") and len(gap) <= 6 and "," not in gap[1:]):
                first, second = prev[1], kind
                comma = "," in gap
                right = (first & 1) and (second & 2) and not comma
                turned = (first & 2) and (second & 1)
                if right or turned:
                    score = 3.5 if right or comma else 2.5
                elif comma:
                    score = -4.0
                elif (first & 1) or (second & 2) or (first | second) & 4:
                    score = -1.2
                else:
                    score = -3.0
                # A word of a sentence's beginning, or of an organisation or street, is no name.
                at = bisect_left(begins, b.end())
                if score > -3 and not (at and ends[at - 1] > a.start()):
                    nodes.append((a.start(), b.end(), [0.0, -6.0, -6.0, -6.0, -6.0, score], (a[0].casefold(), token.casefold())))
                    if score > 2:
                        prev = None
                        continue
        prev = (m, kind)
    nodes.sort(key=lambda x: (x[0], x[1]))
    for a, b, unary, names in nodes:
        out.add(doc, a, b, view[a:b], unary, names)


def edges(s: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, kind) with kind 0 chain, 1 same span, 2 shared name; chains of equal spans link each to the one before."""
    a, b, kind = [], [], []
    last: dict[str, int] = {}
    owner: dict[str, int] = {}
    doc = -1
    for i, d in enumerate(s.doc):
        if d != doc:
            doc, last, owner = d, {}, {}
        elif s.begin[i] - s.end[i - 1] < 80:
            a.append(i - 1)
            b.append(i)
            kind.append(0)
        j = last.get(s.keys[i])
        if j is not None:
            a.append(j)
            b.append(i)
            kind.append(1)
        last[s.keys[i]] = i
        for n in s.names[i]:
            j = owner.get(n)
            if j is not None and s.keys[j] != s.keys[i]:
                a.append(j)
                b.append(i)
                kind.append(2)
            owner[n] = i
    return np.array(a, np.int64), np.array(b, np.int64), np.array(kind, np.int64)


def propagate(unary: np.ndarray, a: np.ndarray, b: np.ndarray, kind: np.ndarray, potentials: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Beliefs (nodes x labels) by loopy sum-product over both directions of every edge."""
    if not len(unary):
        return unary
    pair = potentials[kind]
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    pot = np.concatenate([pair, pair.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    msg = np.zeros((len(src), unary.shape[1]), np.float32)
    belief = unary.astype(np.float32)
    for _ in range(rounds if len(src) else 0):
        out = (belief[src] - msg[back])[:, :, None] + pot
        top = out.max(1)
        new = np.log(np.exp(out - top[:, None, :]).sum(1)) + top
        msg = 0.5 * msg + 0.5 * (new - new.max(1, keepdims=True))
        belief = unary.astype(np.float32).copy()
        np.add.at(belief, dst, msg)
    return belief


def mentions(texts: list[str | None], lex: Lexicon) -> tuple[Spans, np.ndarray]:
    s = Spans()
    for i, t in enumerate(texts):
        if t:
            scan(i, t, lex, s)
    unary = np.array(s.unary, np.float32).reshape(-1, len(LABELS))
    return s, propagate(unary, *edges(s), lex.pair).argmax(1) if len(unary) else np.zeros(0, np.int64)


def redact(texts: list[str | None], lex: Lexicon) -> list[str | None]:
    """The texts with each mention replaced by its type in brackets."""
    s, labels = mentions(texts, lex)
    out = list(texts)
    cut: dict[int, list[tuple[int, int, int]]] = {}
    for k, label in enumerate(labels.tolist()):
        if label != NONE:
            cut.setdefault(s.doc[k], []).append((s.begin[k], s.end[k], label))
    for d, spans in cut.items():
        t, parts, at = texts[d], [], 0
        for a, b, label in sorted(spans):
            if a >= at:
                parts += [t[at:a], f"[{LABELS[label].upper()}]"]
                at = b
        out[d] = "".join(parts) + t[at:]
    return out


def personal(df: DataFrame, record_id: str, fields: list[str], lex, with_text: bool = False) -> DataFrame:
    """field, record_id, pii_type, mention - or, with_text, field, record_id, redacted for every value that isn't null.

    Null and empty values have no mention, repeated rows repeat theirs; other
    columns are ignored.  lex: a broadcast of ``lexicon``.
    """
    src = df.select(F.col(record_id).cast("bigint").alias("__id"), *[F.col(f).cast("string").alias(f"__f{k}") for k, f in enumerate(fields)])

    def found(batch: pa.RecordBatch) -> dict[str, list]:
        ids = batch.column(0).to_pylist()
        rows: dict[tuple, None] = {}
        for k, f in enumerate(fields):
            s, labels = mentions(batch.column(1 + k).to_pylist(), lex.value)
            for n, label in enumerate(labels.tolist()):
                if label != NONE:
                    rows[f, ids[s.doc[n]], LABELS[label], s.keys[n]] = None
        cols = list(zip(*rows)) if rows else [()] * 4
        return dict(zip(("field", "record_id", "pii_type", "mention"), cols))

    def redacted(batch: pa.RecordBatch) -> dict[str, list]:
        ids = batch.column(0).to_pylist()
        out: dict[str, list] = {"field": [], "record_id": [], "redacted": []}
        for k, f in enumerate(fields):
            values = batch.column(1 + k).to_pylist()
            for i, v in zip(ids, redact(values, lex.value)):
                if v is not None:
                    out["field"].append(f)
                    out["record_id"].append(i)
                    out["redacted"].append(v)
        return out

    if with_text:
        return map_batches(src, redacted, "field string, record_id bigint, redacted string")
    return map_batches(src, found, "field string, record_id bigint, pii_type string, mention string")


def _parts(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    m = load(spark, sf_dir, "messages")
    lex = spark.sparkContext.broadcast(lexicon(m, "text"))
    out = personal(m, "message_id", ["text"], lex, with_text)
    out = out.unionByName(personal(load(spark, sf_dir, "message_extracts"), "message_id", ["extracted_text"], lex, with_text))
    return out.unionByName(personal(load(spark, sf_dir, "attachment_results"), "attachment_id", ["extraction"], lex, with_text))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, False).distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, True)
