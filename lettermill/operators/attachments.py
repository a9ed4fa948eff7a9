"""Routing and text of attachments.

Empty and oversized files are told by length in the plan; the rest goes once to an Arrow function
in small batches, because a parser's memory follows its file.  Every row ends with a status, no
file fails a task.
"""

from __future__ import annotations

import signal
import threading
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import archive, parsers
from ..functions import registry as R
from ..functions.charset import decode
from ..functions.jsx import BLANKS
from ..functions.routing import detect_route, extension, parse_type

ROUTE = StructType().add("kind", "string").add("routed_by", "string")
RESULT = StructType().add("status", "string").add("extraction", "string").add("reason", "string")
DECLARED = StructType().add("declared", "string").add("charset", "string").add("extension", "string")
#: Bytes of files that a worker holds at once.
SLICE = 16 << 20


class HandlerTimeout(Exception):
    pass


@contextmanager
def time_limit(ms: int) -> Iterator[None]:
    """Interrupts the reader after ``ms``; off the main thread, where no signal comes, it does nothing."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_: object) -> None:
        raise HandlerTimeout(f"handler exceeded {ms}ms")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, ms / 1000)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def cap(text: str, most: int = R.MAX_OUTPUT_CHARS) -> str:
    """At most ``most`` UTF-16 units, no pair split."""
    if len(text) * 2 <= most or len(text) <= most and text.isascii():
        return text
    units = text.encode("utf-16-le", "surrogatepass")
    if len(units) <= 2 * most:
        return text
    if 0xD8 <= units[2 * most - 1] <= 0xDB:
        most -= 1
    return units[: 2 * most].decode("utf-16-le", "surrogatepass")



def extract_one(b: bytes, filename: str | None, content_type: str | None, timeout_ms: int = R.HANDLER_TIMEOUT_MS) -> tuple[str, str | None, str | None]:
    """(status, extraction or None, reason or None); never raises."""
    if not b:
        return "extracted", None, None
    if len(b) > R.MAX_INPUT_BYTES:
        return "skipped", None, f"{len(b)} bytes exceeds {R.MAX_INPUT_BYTES}"
    try:
        t, charset = parse_type(content_type)
        kind, _ = detect_route(b, filename, content_type)
        if kind is None:
            return "skipped", None, f"unsupported type {t}" if t else "unrecognized attachment"
        entries: dict = {}
        if kind in ("docx", "xlsx"):
            entries = archive.measured(b, R.MAX_UNCOMPRESSED_BYTES)
        with time_limit(timeout_ms):
            text = {
                "text": lambda: decode(b, charset),
                "html": lambda: parsers.html_text(decode(b, charset)),
                "pdf": lambda: parsers.pdf_text(b),
                "docx": lambda: parsers.docx_text(b, entries),
                "doc": lambda: parsers.doc_text(b),
                "xlsx": lambda: parsers.xlsx_text(b, entries),
            }[kind]()
        return "extracted", cap(text) if text.strip(BLANKS) else None, None
    except archive.Refused as e:
        return e.status, None, str(e)
    except Exception as e:  # the bytes may be hostile: an error is an answer
        return "failed", None, str(e) or type(e).__name__


def _batches(df: DataFrame, id_column: str, fn, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * SLICE // max(batch.nbytes, SLICE))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, rows = part.column(0), [fn(b or b"", n, t) for b, n, t in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)))]
                cols = list(zip(*rows)) if rows else [()] * (len(schema.split(",")) - 1)
                arrays = [pa.array([None if x is None else x.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for x in c], pa.string()) for c in cols]
                yield pa.RecordBatch.from_arrays([ids, *arrays], [id_column, *(x.split()[0] for x in schema.split(",")[1:])])

    return df.mapInArrow(run, schema)


def _source(df: DataFrame, id_column: str, content: str, filename: str, content_type: str) -> DataFrame:
    return df.select(F.col(id_column).cast("bigint").alias(id_column), F.col(content).cast("binary").alias("__b"), F.col(filename).cast("string").alias("__n"), F.col(content_type).cast("string").alias("__t"))


def routes(df: DataFrame, id_column: str = "attachment_id", content: str = "content", filename: str = "filename", content_type: str = "content_type") -> DataFrame:
    """id, kind, routed_by of each row; null bytes count as empty, and only the head and directory of a file decide."""
    return _batches(_source(df, id_column, content, filename, content_type), id_column, detect_route, f"{id_column} bigint, kind string, routed_by string")


def extract_attachments(df: DataFrame, id_column: str = "attachment_id", content: str = "content", filename: str = "filename", content_type: str = "content_type") -> DataFrame:
    """id, status, extraction, reason of each row.

    Null and empty bytes are extracted without text whatever their type; files over the size limit are
    skipped by length, and their bytes never reach Python.  Other columns are ignored.
    """
    src = _source(df, id_column, content, filename, content_type)
    size = F.coalesce(F.length("__b"), F.lit(0))
    gated = size > R.MAX_INPUT_BYTES
    over = src.where(gated).select(id_column, F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("extraction"), F.concat(size.cast("string"), F.lit(f" bytes exceeds {R.MAX_INPUT_BYTES}")).alias("reason"))
    rest = _batches(src.where(~gated), id_column, extract_one, f"{id_column} bigint, status string, extraction string, reason string")
    return rest.unionByName(over)


@F.pandas_udf(ROUTE)
def detect_route_udf(content: pd.Series, filename: pd.Series, content_type: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([detect_route(b or b"", n, t) for b, n, t in zip(content, filename, content_type)], columns=["kind", "routed_by"])


@F.pandas_udf(RESULT)
def extract_attachment_udf(content: pd.Series, filename: pd.Series, content_type: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract_one(b or b"", n, t) for b, n, t in zip(content, filename, content_type)], columns=["status", "extraction", "reason"])


@F.pandas_udf(DECLARED)
def declared_udf(filename: pd.Series, content_type: pd.Series) -> pd.DataFrame:
    """What type and name say by themselves: the type without parameters, the charset, the name's extension."""
    return pd.DataFrame([(*parse_type(t), extension(n)) for n, t in zip(filename, content_type)], columns=["declared", "charset", "extension"])
