"""The public surface: whole extraction, each stage by itself, limits, and registration for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .functions.registry import DETECT_MIN_CONFIDENCE, DETECT_SAMPLE_BYTES, HANDLER_TIMEOUT_MS, MAX_INPUT_BYTES, MAX_OUTPUT_CHARS, MAX_PDF_PAGES, MAX_UNCOMPRESSED_BYTES
from .functions.routing import detect_route
from .operators.attachments import detect_route_udf, extract_attachment_udf, extract_attachments, routes
from .operators.html_body import extract_bodies, extract_html, visible_text, with_new_html
from .operators.noise import strip_noise, strip_noise_html
from .operators.text_body import extract_text, is_bounce, split_glued, with_new_text

__all__ = [
    "DETECT_MIN_CONFIDENCE", "DETECT_SAMPLE_BYTES", "HANDLER_TIMEOUT_MS", "MAX_INPUT_BYTES", "MAX_OUTPUT_CHARS", "MAX_PDF_PAGES", "MAX_UNCOMPRESSED_BYTES",
    "detect_route", "detect_route_udf", "extract_attachment_udf", "extract_attachments", "extract_bodies", "extract_html", "extract_text", "is_bounce", "register", "routes",
    "split_glued", "strip_noise", "strip_noise_html", "visible_text", "with_new_html", "with_new_text",
]


def register(spark: SparkSession) -> None:
    """detect_route(content, filename, content_type) and extract_attachment(...) for SQL."""
    spark.udf.register("detect_route", detect_route_udf)
    spark.udf.register("extract_attachment", extract_attachment_udf)
