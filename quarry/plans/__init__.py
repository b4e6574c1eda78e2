"""Registered queries: named plans over the tables, with the SQL that checks them.

Each module of this package that holds queries defines ``QUERIES`` (name to callable
of session and data directory) and ``SQL`` (name to text).
"""

from __future__ import annotations

import importlib

MODULES = ("multivalue", "retrieval", "text", "search", "catalog", "chat", "quality", "evaluation", "dedup", "streams", "extraction", "answers")


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= importlib.import_module(f"{__name__}.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= importlib.import_module(f"{__name__}.{m}").SQL
    return out
