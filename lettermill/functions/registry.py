"""File types, limits and magic numbers of attachments."""

from __future__ import annotations

MAX_INPUT_BYTES = 10 * 1024 * 1024
MAX_OUTPUT_CHARS = 250_000
MAX_PDF_PAGES = 2000
MAX_UNCOMPRESSED_BYTES = 50 * 1024 * 1024
HANDLER_TIMEOUT_MS = 10_000
SNIFF_BYTES, SNIFF_TEXT_RATIO = 8 * 1024, 0.85
DETECT_SAMPLE_BYTES, DETECT_MIN_CONFIDENCE = 64 * 1024, 0.7

CONTENT_TYPES = {
    "text": (
        "text/plain", "text/csv", "text/tab-separated-values", "text/markdown", "text/calendar", "application/ics", "text/vcard", "text/x-vcard", "text/enriched", "message/global-headers",
        "message/delivery-status", "message/feedback-report", "text/rfc822-headers", "application/json", "application/xml", "application/yaml", "application/x-yaml", "text/yaml",
    ),
    "html": ("text/html", "application/xhtml+xml"),
    "pdf": ("application/pdf", "application/x-pdf", "application/acrobat", "application/vnd.pdf"),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",),
    "doc": ("application/msword",),
    "xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",),
}
EXTENSIONS = {
    "text": (".txt", ".log", ".csv", ".tsv", ".md", ".markdown", ".ics", ".vcf", ".json", ".xml", ".yaml", ".yml"),
    "html": (".html", ".htm", ".xhtml"),
    "pdf": (".pdf",),
    "docx": (".docx",),
    "doc": (".doc",),
    "xlsx": (".xlsx",),
}
GENERIC_TYPES = ("application/octet-stream", "binary/octet-stream", "application/download", "application/unknown")
OTHER_OLE = (".xls", ".ppt", ".msg")
PDF, ZIP, RTF, OLE = b"%PDF-", b"PK\x03\x04", b"{\\rtf", bytes.fromhex("d0cf11e0a1b11ae1")
DOCX_PART, XLSX_PART = "word/document.xml", "xl/workbook.xml"

TYPE_KIND = {t: k for k, ts in CONTENT_TYPES.items() for t in ts}
EXTENSION_KIND = {e: k for k, es in EXTENSIONS.items() for e in es}
