"""Quoted history and signatures in emails (problem 3).

A body is a row of lines, each with a class (prose, quoted, attribution, header
field, divider, contact detail, ...).  Runs of one class are the units of a
semi-Markov model with four labels.  A segment's score has its units' emissions,
boundary cues at its first unit, its length in lines, and features of the whole
span (a signature must hold a contact detail, a client line or a post; a quoted
span of one short line is doubtful).  The best segmentation comes from a Viterbi
recursion over segment ends and durations.  Bodies with equal rows of units share
one decoding, so a batch is decoded once per distinct row.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _html
from ._batch import load, map_batches

AUTHORED, HISTORY, SIGNATURE, DISCLAIMER = range(4)
KINDS = ("authored", "history", "signature", "disclaimer")
(BLANK, PROSE, QUOTED, ATTRIBUTION, FIELD_FROM, FIELD, DIVIDER, RULE, DELIMITER, CLIENT, CONTACT, POST, NAME, CLOSING, FIRST, LEGAL, SHORT, ITEM, BOXED) = range(19)
#: Emissions, by class: authored, history, signature, disclaimer.
EMIT = {
    PROSE: (0.0, -0.5, -5.0, -2.0),
    QUOTED: (-3.0, 2.5, -6.0, -6.0),
    ATTRIBUTION: (-5.0, 3.0, -6.0, -6.0),
    FIELD_FROM: (-5.0, 3.0, -6.0, -6.0),
    FIELD: (-1.5, 1.5, -3.0, -4.0),
    DIVIDER: (-5.0, 3.0, -5.0, -5.0),
    RULE: (-0.5, 0.0, -0.5, 0.0),
    DELIMITER: (-0.8, -1.0, 1.5, 0.2),
    CLIENT: (-4.0, -1.5, 3.5, -3.0),
    CONTACT: (-1.5, -0.5, 2.0, -3.0),
    POST: (-0.8, -0.6, 1.6, -3.0),
    NAME: (-0.3, -0.5, 1.0, -3.0),
    CLOSING: (0.8, -0.5, -2.5, -4.0),
    FIRST: (0.3, -0.5, -0.8, -4.0),
    LEGAL: (-4.0, -0.8, -3.0, 3.5),
    SHORT: (0.0, -0.4, -1.5, -1.5),
    ITEM: (0.0, -0.5, -4.0, -4.0),
    BOXED: (-1.0, -1.0, 2.0, -1.0),
}
#: Boundary cues: what a segment costs to begin with a class; classes not named cost the last figure.
START = {
    AUTHORED: ({}, 0.0),
    HISTORY: ({ATTRIBUTION: 0.0, FIELD_FROM: 0.0, DIVIDER: 0.0, QUOTED: -0.5, RULE: -1.0, FIELD: -3.0}, -9.0),
    SIGNATURE: ({DELIMITER: 0.3, NAME: -0.5, CLIENT: 0.0, BOXED: 0.0, POST: -1.5, CONTACT: -2.0, RULE: -1.0}, -7.0),
    DISCLAIMER: ({LEGAL: 0.0, RULE: -0.8, DELIMITER: -1.0}, -7.0),
}
LONGEST = 48

_MARK = re.compile(r"^\s*(?:>\s?)+|^\s*\|(?=\s|$)(?!.*\|\s*$)(?!\s*\d+\s*\|\|)(?!.*\|\|)")
_ADDRESS = re.compile(r"<[^<>\s]+@[^<>\s]+>|\b[\w.+-]+@[\w-]+\.[\w.-]+")
_BRACKETED = re.compile(r"<[^<>\s]+@[^<>\s]+>")
#: Words for "wrote" in attributions, and labels of header fields.
_WROTE = r"wrote|schrieb|a\s+écrit|escribió|ha scritto|escreveu|schreef|skrev|napisał(?:a|\(a\))?|написал(?:а|\(а\))?|пишет"
_ATTR_END = re.compile(rf"(?:<[^<>\s]+@[^<>\s]+>|\b(?:{_WROTE}))\s*(?:{_WROTE})?\s*[:：]\s*$", re.I)
_ATTR_DASHED = re.compile(rf"^\s*-{{2,}}\s*\S.*\b(?:{_WROTE})(?!\w)\s*:?\s*-{{2,}}\s*$", re.I)
_DATED = re.compile(r"(?:\b(?:19|20)\d\d\b.*\d{1,2}[:.]\d\d|\d{1,2}[:.]\d\d.*\b(?:19|20)\d\d\b)")
_OPENER = re.compile(r"^\s*(?:On|Am|Le|El|Il|Em|Op|Den|W dniu|\d{1,2} [а-я]+\.?|\d{4}-\d\d-\d\d)\s", re.I)
_FROM = re.compile(r"^\s*\*?(?:From|Von|De|Da|Van|Från|Fra|Od|От|Отправитель|Expéditeur|Remitente|Nadawca)\s*\*?\s*:\s*\*?\s*\S", re.I)
_FIELD = re.compile(r"^\s*\*?(?:Sent|Date|To|Cc|Bcc|Subject|Reply-To|Gesendet|Datum|An|Kopie|Betreff|Envoyé|À|Objet|Enviado(?: el)?|Fecha|Para|Asunto|Wysłano|Data|Do|DW|Temat|Отправлено|Дата|Кому|Копия|Тема)\s*\*?\s*:\s*\S", re.I)
_DIVIDER = re.compile(r"^\s*(?:-{3,} ?[^\W\d_][^\d<>@|-]{2,44}? ?-{2,}|Begin forwarded message:?|Anfang der weitergeleiteten Nachricht:?|Début du message (?:transféré|réexpédié) ?:?)\s*$", re.I)
_RULE = re.compile(r"^\s*(?:_{8,}|-{10,}|={10,}|\*{8,})\s*$")
_DELIMITER = re.compile(r"^\s*(?:-{2,3}|_{2,5}|—{1,3}|–{2,3}|\*\s?\*\s?\*|~{2,4}|={2,4})\s*$")
_CLIENT = re.compile(r"^\s*(?:sent (?:from|via|with)\b|get (?:the )?[\w ]{2,20}\bapp\b|get \w+ for \w+|(?:von|aus) meinem .{2,24} gesendet|gesendet (?:von|mit)\b|envoyé (?:de|depuis) mon\b|enviado (?:desde|con) mi\b|wysłan[oe] z mojego\b|z mojego telefonu\b|отправлено с\b|verzonden vanaf\b|inviato da(?:l mio)?\b)", re.I)
_CONTACT = re.compile(r"^\s*(?:(?:tel|telefon|phone|mobile|mob|cell|fax|e-?mail|mail|web|www|t|m|p|f|e|tél|móvil|тел)\b\.?\s*[:.]?\s*)?(?:[\w.+-]+@[\w-]+\.[\w.-]+|(?:https?://|www\.)\S+|\+?[\d(][\d ()./-]{7,20}\d)\s*$", re.I)
_STREET = re.compile(r"^\s*(?:\d{1,4}\s?(?:[a-z]|bis|ter)?,? +\S.{2,40}|[^\W\d_].{3,40}?,? +\d{1,4} ?[a-z]?)\s*$")
_STREET_WORD = re.compile(r"\b(?:street|road|lane|avenue|close|drive|court|way|square|terrace|place|boulevard|st|rd|ave|rue|chemin|quai|calle|avenida|plaza|paseo|ul|ул)\b\.?|(?:straße|strasse|str\.|gasse|weg|allee|platz|ring)\b", re.I)
_WORDS = re.compile(r"[^\W\d_][\w.'’&-]*")
_CLOSING = re.compile(r"^\s*(?:(?:kind|best|warm)? ?regards|best(?: wishes)?|cheers|thanks(?: a lot| again)?|many thanks|thank you|sincerely|yours(?: \w+)?|all the best|mit freundlichen grüßen|(?:viele|beste|liebe|schöne) grüße|gruß|danke(?: und gruß)?|cordialement|bien à (?:vous|toi)|merci(?: d'avance)?|bonne journée|salutations|saludos(?: cordiales)?|un saludo|muchas gracias|hasta pronto|atentamente|z poważaniem|pozdrawiam|dziękuję(?: i pozdrawiam)?|с уважением|всего доброго|спасибо)\s*[,.!]?\s*$", re.I)
_ITEM = re.compile(r"^\s*(?:[-*+•·–]|\d{1,3}[.)]|#+)\s+\S")
#: Turns of phrase of legal, print and list notices.
_LEGAL = re.compile(
    r"meant only for|intended (?:solely|only|exclusively) for|intended recipient|not the (?:person|addressee|recipient)|may (?:be|contain) (?:confidential|privileged)|legally (?:protected|privileged)"
    r"|must not copy|by mistake please|(?:views|opinions)[^.\n]{0,40}(?:writer|author|sender)|do(?:es)? not bind|before (?:you )?print|confidentiality notice"
    r"|(?:getting|receiving|received) this (?:because|e-?mail|message|mail)|to (?:leave (?:this|the|our) (?:list|group|newsletter)|unsubscribe,)|unsubscribe (?:here|at|from this)|leave the list|foot of the page|manage (?:your )?(?:preferences|subscription)"
    r"|nur für den|ausschließlich für|vertrauliche (?:angaben|informationen)|irrtümlich|allein die meinung|keiner weise verbindlich|vor dem (?:aus)?drucken"
    r"|destiné (?:uniquement|exclusivement)|informations confidentielles|reçu par erreur|opinions exprimées|n'engagent|avant d'imprimer"
    r"|dirigido (?:solo|únicamente|exclusivamente)|información confidencial|recibido por error|opiniones expresadas|antes de imprimir"
    r"|przeznaczon[ae] wyłącznie|informacje poufne|przez pomyłkę|opinie wyrażone"
    r"|предназначено только|закрытые сведения|конфиденциальн\w+ (?:информаци|сведени)|по ошибке",
    re.I,
)


#: Each turn of phrase above holds one of these; lines without any aren't searched for it.
_LEGAL_PARTS = (
    "only for", "exclusively for", "intended", "not the ", "confidential", "privileged", "legally", "must not copy", "mistake", "views", "opinions", "bind", "before print", "you print", "getting this", "receiving this", "received this", "unsubscribe",
    "leave the list", "leave this", "leave our", "leave the group", "leave the newsletter", "foot of the page", "manage ", "nur für", "ausschließlich", "vertraulich", "irrtümlich", "allein die meinung", "verbindlich", "drucken", "destiné", "confidentiel",
    "par erreur", "engagent", "imprimer", "dirigido", "confidencial", "por error", "opiniones", "przeznaczon", "poufne", "pomyłk", "opinie", "предназначено", "сведени", "конфиденциальн", "ошибке",
)


def legal(line: str) -> bool:
    low = line.lower()
    return any(p in low for p in _LEGAL_PARTS) and _LEGAL.search(line) is not None


def _caps(words: list[str]) -> bool:
    return all(w[0].isupper() for w in words)


@lru_cache(1 << 16)
def _short_class(line: str) -> int:
    """Class of a line of fewer than 60 characters that isn't quoted."""
    if _DELIMITER.match(line):
        return DELIMITER
    if _RULE.match(line):
        return RULE
    if _ATTR_DASHED.match(line):
        return ATTRIBUTION
    if _DIVIDER.match(line):
        return DIVIDER
    if _CLIENT.match(line):
        return CLIENT
    if _CLOSING.match(line):
        return CLOSING
    if _CONTACT.match(line):
        return CONTACT
    if legal(line):
        return LEGAL
    if _STREET.match(line) and _STREET_WORD.search(line) and len(_WORDS.findall(line)) <= 6:
        return CONTACT
    if _ITEM.match(line):
        return ITEM
    words = _WORDS.findall(line)
    bare = line.strip()
    if bare[-1:] in ".!?…:;":
        return SHORT
    if not words or any(c.isdigit() for c in bare):
        return SHORT
    if len(words) == 1 and _caps(words) and bare[-1] != ",":
        return FIRST
    if ("," in bare[:-1] or " | " in bare) and 2 <= len(words) <= 8 and words[0][0].isupper() and words[-1][0].isupper() and bare[-1] != ",":
        # A post with its firm: what stands behind the comma or bar is capitalised.
        head, _, tail = bare.replace(" | ", ",").partition(",")
        parts = _WORDS.findall(tail)
        if parts and _caps(parts) and len(_WORDS.findall(head)) >= 1 and (" | " in bare or len(parts) > 1):
            return POST
    if 2 <= len(words) <= 3 and _caps(words) and bare[-1] != ",":
        return NAME
    return SHORT


def line_class(line: str, quoted: bool = False, boxed: bool = False) -> int:
    bare = line.strip()
    if not bare:
        return BLANK
    if quoted:
        return QUOTED
    if bare[0] in ">|" and _MARK.match(line):
        return QUOTED
    if bare[-1] in ":：" and _ATTR_END.search(bare) and (_DATED.search(bare) or _BRACKETED.search(bare)):
        return ATTRIBUTION
    if len(bare) < 180:
        if _FROM.match(bare):
            return FIELD_FROM if _ADDRESS.search(bare) else FIELD if not _LOOSE.search(bare) else SHORT
        if _OPENER.match(bare) and _DATED.search(bare) and len(bare) < 120:
            return ATTRIBUTION
        if _FIELD.match(bare):
            return FIELD
    if len(bare) < 60:
        kind = _short_class(bare)
        return BOXED if boxed and kind in (SHORT, FIRST, NAME) else kind
    if legal(bare):
        return LEGAL
    if boxed:
        return BOXED
    return PROSE


#: "From: the gate, to: the yard" is a sentence.
_LOOSE = re.compile(r":[^:]*[,\s][^\W\d_]+\s*:|[.!?]\s*$")


def classify(value: str, markup: bool = False) -> tuple[list[str], list[int], list[bool]]:
    """Lines, their classes, and whether a quote's container leaves no doubt of them."""
    sure: list[bool] = []
    if markup:
        rows = _html.blocks(value)
        lines = [r[0].replace("\xa0", " ").strip() for r in rows]
        classes = [line_class(t, q > 0, s > 0) for t, (_, q, s) in zip(lines, rows)]
        sure = [q > 0 for _, q, _ in rows]
    else:
        lines = re.split(r"\r\n|\n|\r", value)
        classes = [line_class(t) for t in lines]
    for i, c in enumerate(classes):
        # The lines of a legal notice and of a list notice go on after the first one's cue.
        if c == PROSE or c == SHORT:
            if i and classes[i - 1] == LEGAL and lines[i - 1].strip()[-1:] not in ".!?":
                classes[i] = LEGAL
        if c == ATTRIBUTION and not lines[i].rstrip().endswith((":", "：", "-")):
            # An opener with a date counts only where the attribution goes on below.
            nxt = next((lines[k] for k in range(i + 1, min(i + 3, len(lines))) if lines[k].strip()), "")
            if not (_ATTR_END.search(nxt.strip()) and _BRACKETED.search(nxt) or re.fullmatch(rf"\s*(?:{_WROTE})?\s*[:：]\s*", nxt, re.I)):
                classes[i] = PROSE if len(lines[i]) >= 60 else SHORT
    # The first line of a wrapped notice may lack the cue that its next line has.
    for i in range(len(classes) - 2, -1, -1):
        if classes[i + 1] == LEGAL and classes[i] in (PROSE, SHORT) and lines[i].strip()[-1:] not in ".!?:," and (i == 0 or classes[i - 1] not in (PROSE,)):
            classes[i] = LEGAL
    return lines, classes, sure or [False] * len(lines)


def units(lines: list[str], classes: list[int], contained: list[bool]) -> tuple[tuple[int, int, bool], ...]:
    """Runs of one class as (class, lines, quoted for sure); blank lines part no run.

    Lengths grow by steps (1, 2, 3, 4, 6, 8, 12, 16, 24, ... without end), so that bodies of about the same lengths share one decoding.
    """
    out: list[list] = []
    for t, c, box in zip(lines, classes, contained):
        if c == BLANK:
            continue
        # One quoted line is doubtful if it is short, but for one in a quote's container.
        sure = c == QUOTED and (box or len(t) >= 60)
        if out and out[-1][0] == c:
            out[-1][1] += 1
            out[-1][2] = out[-1][2] or sure
        else:
            out.append([c, 1, sure])
    return tuple((c, step(n), sure) for c, n, sure in out)


@lru_cache(1 << 12)
def step(n: int) -> int:
    """The length at which n stands: two steps to each doubling."""
    half = 1 << max(n.bit_length() - 2, 0)
    return n // half * half


@lru_cache(1 << 15)
def decode(row: tuple[tuple[int, int, bool], ...]) -> tuple[int, ...]:
    """The best label of each unit."""
    n = len(row)
    weight = [1.0 if c in (FIELD_FROM, ATTRIBUTION, DIVIDER) else k**0.5 for c, k, _ in row]
    sums = [[0.0] * (n + 1) for _ in range(4)]
    for y in range(4):
        acc = 0.0
        for i, (c, _, _) in enumerate(row):
            acc += EMIT[c][y] * weight[i]
            sums[y][i + 1] = acc
    marks = {c: [0] * (n + 1) for c in (QUOTED, ATTRIBUTION, FIELD_FROM, FIELD, DIVIDER, CLIENT, CONTACT, POST, PROSE, LEGAL, NAME, SHORT, BOXED, FIRST, CLOSING)}
    for c, m in marks.items():
        for i, (k, size, _) in enumerate(row):
            m[i + 1] = m[i] + (size if k == c else 0)
    solid = [0] * (n + 1)
    for i, (_, k, _) in enumerate(row):
        solid[i + 1] = solid[i] + k

    def span(i: int, j: int, y: int) -> float:
        c, k, long_ = row[i]
        cues, other = START[y]
        score = sums[y][j] - sums[y][i] + cues.get(c, other)
        has = lambda *cs: sum(marks[x][j] - marks[x][i] for x in cs)
        if y == SIGNATURE:
            size = solid[j] - solid[i]
            strong = has(CLIENT, CONTACT, POST)
            score += -5.0 if not strong and not has(BOXED) else 0.0
            score -= 0.8 * max(0, size - 8)
            if c in (CONTACT, POST) and not has(NAME, CLIENT) and size < 2:
                score -= 1.5
        elif y == HISTORY:
            if c == FIELD and not has(FIELD_FROM, ATTRIBUTION, DIVIDER) and has(FIELD) < 3:
                score -= 5.0
            if c == QUOTED and not has(ATTRIBUTION, FIELD_FROM, DIVIDER) and has(QUOTED) == 1 and not long_:
                score -= 6.0
            if has(QUOTED):
                # Between marked lines, unmarked ones are answers.
                score -= 2.0 * (has(PROSE) ** 0.5 + has(SHORT, FIRST, NAME, CLOSING) ** 0.5)
            if c == RULE and not has(FIELD_FROM, ATTRIBUTION, DIVIDER, QUOTED):
                score -= 6.0
        elif y == DISCLAIMER:
            score -= 0.7 * max(0, solid[j] - solid[i] - 10)
            if not has(LEGAL):
                score -= 9.0
        return score

    best = [[-1e18] * 4 for _ in range(n + 1)]
    back: list[list[tuple[int, int]]] = [[(0, 0)] * 4 for _ in range(n + 1)]
    for j in range(1, n + 1):
        for i in range(max(0, j - LONGEST), j):
            for y in range(4):
                s = span(i, j, y)
                if i == 0:
                    if s > best[j][y]:
                        best[j][y], back[j][y] = s, (0, -1)
                    continue
                for x in range(4):
                    prev = best[i][x]
                    if prev < -1e17:
                        continue
                    t = prev + s - 0.3
                    if x == y:
                        # A run longer than LONGEST goes on; two notices or quoted spans may meet.
                        t -= 0.2 if j - i == LONGEST or y in (DISCLAIMER, HISTORY) else 4.0
                    if x == HISTORY and y == AUTHORED:
                        a = back[i][HISTORY][0]
                        bare = sum(k for c, k, _ in row[a:i] if c == PROSE)
                        # Below history without marks hardly anything is newly written.
                        t -= 6.0 if bare and not any(c == QUOTED for c, _, _ in row[a:i]) else 0.3
                    if t > best[j][y]:
                        best[j][y], back[j][y] = t, (i, x)
    y = max(range(4), key=lambda k: best[n][k])
    out = [0] * n
    j = n
    while j > 0:
        i, x = back[j][y]
        for k in range(i, j):
            out[k] = y
        j, y = i, x
    return tuple(out)


_PLAIN = frozenset((BLANK, PROSE, CLOSING, FIRST, SHORT, ITEM))


def spans(value: str, markup: bool = False) -> list[tuple[int, str]]:
    """(label, text) of the segments of a body, in order."""
    lines, classes, contained = classify(value, markup)
    row = units(lines, classes, contained)
    if all(c in _PLAIN for c, _, _ in row):  # nothing that a segment of another label could begin with
        return [(AUTHORED, "\n".join(lines))]
    labels = decode(row)
    out: list[tuple[int, list[str]]] = []
    k, last = -1, None
    for t, c in zip(lines, classes):
        if c != BLANK:  # blank lines go with what stands before them
            k += c != last
            last = c
        y = labels[max(k, 0)]
        if out and out[-1][0] == y:
            out[-1][1].append(t)
        else:
            out.append((y, [t]))
    return [(y, "\n".join(ts)) for y, ts in out]


def newly_written(df: DataFrame, record_id: str, fields: dict[str, bool], only_kinds: bool = False) -> DataFrame:
    """field, record_id, authored, kinds (what else the body holds), one row for each body that isn't null.

    fields: column name to whether it is HTML.  An empty body gives an empty text
    and no kinds, repeated rows repeated rows; other columns are ignored.  With
    only_kinds, bodies wholly newly written give no row and authored is null.
    """
    src = df.select(F.col(record_id).cast("bigint").alias("__id"), *[F.col(f).cast("string").alias(f"__f{k}") for k, f in enumerate(fields)])

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        ids = batch.column(0).to_pylist()
        out: dict[str, list] = {"field": [], "record_id": [], "authored": [], "kinds": []}
        for k, (f, markup) in enumerate(fields.items()):
            for i, v in zip(ids, batch.column(1 + k).to_pylist()):
                if v is None:
                    continue
                parts = spans(v, markup)
                kinds = sorted({KINDS[y] for y, t in parts if y != AUTHORED and t.strip()})
                if kinds or not only_kinds:
                    out["field"].append(f)
                    out["record_id"].append(i)
                    out["authored"].append(None if only_kinds else "\n".join(t for y, t in parts if y == AUTHORED).strip())
                    out["kinds"].append(kinds)
        return out

    return map_batches(src, run, "field string, record_id bigint, authored string, kinds array<string>")


def _parts(spark: SparkSession, sf_dir: str, only_kinds: bool) -> DataFrame:
    a = newly_written(load(spark, sf_dir, "messages"), "message_id", {"text": False, "html": True}, only_kinds)
    return a.unionByName(newly_written(load(spark, sf_dir, "message_extracts"), "message_id", {"extracted_text": False}, only_kinds))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, True).select("field", F.col("record_id").alias("message_id"), F.explode("kinds").alias("kind")).distinct()


def p3_authored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, False).select("field", F.col("record_id").alias("message_id"), "authored").dropDuplicates(["field", "message_id"])
