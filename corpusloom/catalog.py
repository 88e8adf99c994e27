"""Registered queries of the core library and their SQL oracles."""

from __future__ import annotations

from corpusloom.plans import evolving, filters, joins, linked, ranked, scans, totals, wording  # noqa: F401  (importing registers)
from corpusloom.plans.base import REGISTER, Query


def queries() -> dict[str, Query]:
    return {name: found.run for name, found in REGISTER.items()}


def oracle_sql() -> dict[str, str]:
    return {name: found.sql for name, found in REGISTER.items() if found.sql}


def inventory() -> dict[str, list[str]]:
    """The queries that cover each row of the operator inventory."""
    found: dict[str, list[str]] = {}
    for name, entry in REGISTER.items():
        for row in entry.rows:
            found.setdefault(row, []).append(name)
    return found
