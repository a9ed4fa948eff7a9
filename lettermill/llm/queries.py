"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Module, and its queries.
QUERIES = {
    "markup": ["p1_found", "p1_clean", "p1_templates"],
    "unify": ["p2_found", "p2_forms"],
    "authored": ["p3_found", "p3_authored"],
    "personal": ["p4_found", "p4_redacted"],
    "encoding": ["p5_found", "p5_restored"],
    "truncation": ["p7_found", "p7_rates"],
    "language": ["p6_found", "p6_segments"],
    "leakage": ["p8_found", "p8_items"],
    "mixing": ["p9_mixture", "p9_shares", "p9_promises"],
    "quality": ["p10_found", "p10_statistics"],
}
#: Module and function that give a query's SQL.
SQL = {"p2_found": ("unify", "found_sql"), "p9_promises": ("mixing", "promises_sql"), "p10_found": ("quality", "found_sql"), "p10_statistics": ("quality", "statistics_sql")}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {q: getattr(importlib.import_module(f"{__package__}.{m}"), q) for m, names in QUERIES.items() for q in names}
    return dict(sorted(found.items(), key=lambda x: (int(x[0][1:].split("_")[0]), not x[0].endswith("_found"))))


def oracle_sql() -> dict[str, str]:
    return {q: getattr(importlib.import_module(f"{__package__}.{m}"), f)() for q, (m, f) in SQL.items()}
