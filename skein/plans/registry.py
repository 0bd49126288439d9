"""The queries over the driver's tables and their SQL."""

from __future__ import annotations

from . import editorial, evidence, facts, stories, texts

MODULES = (stories, texts, facts, editorial, evidence)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
