"""Cases that the tables lack, each with what must come of it: a query runs the operators on them, the SQL lists the outcomes."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attachments as A
from ..operators import html_body as H
from ..operators import text_body as T

_ANN = "Ann <ann@poe.test>"
TEXTS = {
    "phone line": ("Fine.\nSent from Samsung Galaxy, ann@poe.test wrote", "Fine."),
    "phone line, no address": ("Fine.\nSent from Samsung Galaxy wrote", "Fine."),
    "chinese verb": ("好。\n安 写道：\n旧", "好。"),
    "chinese verb, colon in ascii": ("好。\n安 写道 :\n旧", "好。"),
    "chinese verb within prose": ("安写道了。", "安写道了。"),
    "chinese sender": ("好。\n发件人： 安\n旧", "好。"),
    "chinese sender, blank": ("好。\n发件人 安\n旧", "好。"),
    "arabic verb": ("حسنا\nآن كتب:\nقديم", "حسنا"),
    "glued": (f"Fine. On Mon, Jan 6, 2025 at 9:00 AM {_ANN} wrote:\n> old", "Fine."),
    "glued, german": (f"Gut. Am 06.01.2025 um 09:00 schrieb {_ANN} und schrieb:\n> alt", "Gut."),
    "glued, no date": (f"Fine. On that day {_ANN} wrote: yes", f"Fine. On that day {_ANN} wrote: yes"),
    "bounce, headline": ("Delivery has failed to these people\n> a\n> b", "Delivery has failed to these people\n> a\n> b"),
    "bounce, field": ("Reporting-MTA: dns; mx.poe.test\n> a\n> b", "Reporting-MTA: dns; mx.poe.test\n> a\n> b"),
    "bounce, within the line": ("The server rejected your message to Bob\n> a\n> b", "The server rejected your message to Bob\n> a\n> b"),
    "bounce behind tags": ("[EXT]\nhttps://poe.test/x\nUndelivered mail\n> a\n> b", "[EXT]\nhttps://poe.test/x\nUndelivered mail\n> a\n> b"),
    "no bounce below": ("Fine.\nUndelivered mail\n> a\n> b", "Fine.\nUndelivered mail"),
    "signature kept": ("Fine.\nOn Mon Ann wrote:\n> a\n> b\n-- \nBob\nBuyer", "Fine.\n-- \nBob\nBuyer"),
    "forward kept": ("See.\n---------- Forwarded message ---------\nFrom: ann@poe.test", "See.\n---------- Forwarded message ---------\nFrom: ann@poe.test"),
    "empty": ("", None),
}
PAGES = {
    "append on send": ('<p>Fine</p><div id="appendonsend"></div>old', "<p>Fine</p>"),
    "chinese verb": ("<p>好</p><p>安写道：旧</p>", "<p>好</p>"),
    "chinese sender": ("<p>好</p><p>发件人 : 安</p>", "<p>好</p>"),
    "arabic verb": ("<p>حسنا</p><p>آن كتب:</p>", "<p>حسنا</p>"),
    "bounce": ("<p>Delivery has failed</p><blockquote>old</blockquote>", "<p>Delivery has failed</p><blockquote>old</blockquote>"),
    "forward": ("<p>Fine</p>---------- Forwarded message ----------<p>From: ann@poe.test</p>", "<p>Fine</p>---------- Forwarded message ----------<p>From: ann@poe.test</p>"),
    "signature back": ("<p>Fine</p><blockquote>old</blockquote></div><br><div>Regards, Bob</div>", "<p>Fine</p><div>Regards, Bob</div>"),
    "more quoting": ("<p>Fine</p><blockquote>old</blockquote><div>On Mon Cy wrote: regards</div>", "<p>Fine</p>"),
    "signature too long": (f"<p>Fine</p><blockquote>old</blockquote><div>Regards {'x' * 500}</div>", "<p>Fine</p>"),
    "footer below": ("<p>Fine</p><blockquote>old</blockquote><div>Regards, Bob</div><div>You received this e-mail</div><div></div>", "<p>Fine</p><div>Regards, Bob</div>"),
    "mark within a tag": ('<p>Fine</p><p title="x">On Mon <b>Ann</b> wrote:</p>', "<p>Fine</p>"),
    "empty": ("", None),
}


def _zip(entries: list[tuple[str, bytes, int]], count: int | None = None, gap: bytes = b"", comp: int | None = None, packed: int | None = None) -> bytes:
    """An archive of (name, stored bytes, method), with what it declares bent as asked."""
    body, central = b"", b""
    for name, data, method in entries:
        n, size = name.encode(), len(data) if packed is None else packed
        central += struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 20, 20, 0, method if comp is None else comp, 0, 0, 0, size, 0, len(n), 0, 0, 0, 0, 0, len(body)) + n
        body += struct.pack("<4s5H3I2H", b"PK\x03\x04", 20, 0, method, 0, 0, 0, size, 0, len(n), 0) + n + data
    return body + central + gap + struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, len(entries) if count is None else count, len(entries) if count is None else count, len(central), len(body), 0)


def _deflated(data: bytes) -> bytes:
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    return z.compress(data) + z.flush()


_PART, _BIG, _BAD = "xl/workbook.xml", 51 * 1024 * 1024, "malformed zip: "
#: Name, bytes, file name, content type, and status, characters of text, reason.
FILES = {
    "empty": (lambda: b"", "x.pdf", "application/pdf", ("extracted", None, None)),
    "white space": (lambda: b" \n\t", "x.txt", None, ("extracted", None, None)),
    "too large": (lambda: b"a" * (10 * 1024 * 1024 + 1), "x.txt", "text/plain", ("skipped", None, "10485761 bytes exceeds 10485760")),
    "output cut": (lambda: b"a" * 500_000, "x.txt", "text/plain", ("extracted", 250_000, None)),
    "output cut within a pair": (lambda: b"a" * 249_999 + "😀".encode() * 2, "x.txt", "text/plain", ("extracted", 249_999, None)),
    "rich text": (lambda: b"{\\rtf1 hi}", "x.txt", "text/plain", ("skipped", None, "unsupported type text/plain")),
    "unknown": (lambda: b"\x00\x01\x02", None, None, ("skipped", None, "unrecognized attachment")),
    "broken pdf": (lambda: b"%PDF-1.4 nothing", "x.pdf", None, ("failed", None, None)),
    "no end record": (lambda: b"PK\x03\x04" + _PART.encode(), "x.xlsx", None, ("failed", None, _BAD + "no end-of-central-directory record")),
    "far sizes": (lambda: _zip([(_PART, b"x", 0)], packed=0xFFFFFFFF), "x.xlsx", None, ("skipped", None, "zip declares a ZIP64 / out-of-range size")),
    "gap before the end record": (lambda: _zip([(_PART, b"x", 0)], gap=b"...."), "x.xlsx", None, ("failed", None, _BAD + "central directory does not end at the end-of-central-directory record")),
    "data past the end": (lambda: _zip([(_PART, b"x", 0)], packed=9999), "x.xlsx", None, ("failed", None, _BAD + "compressed data runs past end of file")),
    "other method": (lambda: _zip([(_PART, b"x", 0)], comp=12), "x.xlsx", None, ("skipped", None, "zip uses unsupported compression method 12")),
    "broken stream": (lambda: _zip([(_PART, b"\xff\xff\xff\xff", 8)]), "x.xlsx", None, ("failed", None, _BAD + "unreadable compressed data")),
    "bomb": (lambda: _zip([(_PART, _deflated(bytes(_BIG)), 8)]), "x.xlsx", None, ("skipped", None, "decompresses to over 52428800 bytes")),
    "hidden record": (lambda: _zip([(_PART, b"x", 0), ("y", b"y", 0)], count=1), "x.xlsx", None, ("failed", None, _BAD + "central directory holds more records than it declares")),
}


def case_texts(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([(k, t) for k, (t, _) in TEXTS.items()], "name string, text string")
    return T.extract_text(df).select("name", "extracted_text")


def case_pages(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([(k, t) for k, (t, _) in PAGES.items()], "name string, html string")
    return H.extract_html(df).select("name", "extracted_html")


def case_files(spark: SparkSession, d: str) -> DataFrame:
    """Status, characters of text and reason of each file; a reader's own words about a broken file aren't compared."""
    keys = list(FILES)
    df = spark.createDataFrame([(i, bytearray(FILES[k][0]()), *FILES[k][1:3]) for i, k in enumerate(keys)], "attachment_id bigint, content binary, filename string, content_type string")
    name = F.element_at(F.array(*[F.lit(k) for k in keys]), (F.col("attachment_id") + 1).cast("int"))
    return A.extract_attachments(df).select(name.alias("name"), "status", F.length("extraction").cast("bigint").alias("n_chars"), F.when(name != "broken pdf", F.col("reason")).alias("reason"))


def _values(rows, columns: str) -> str:
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns})"


SQL = {
    "case_texts": _values([(k, w) for k, (_, w) in TEXTS.items()], "name, extracted_text"),
    "case_pages": _values([(k, w) for k, (_, w) in PAGES.items()], "name, extracted_html"),
    "case_files": _values([(k, *w) for k, (*_, w) in FILES.items()], "name, status, n_chars, reason").replace("SELECT *", "SELECT name, status, CAST(n_chars AS BIGINT) AS n_chars, CAST(reason AS VARCHAR) AS reason"),
}
QUERIES = (case_texts, case_pages, case_files)
