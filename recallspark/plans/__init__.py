"""The registered queries of the library's own operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from . import cost, journal, lens, memory, relations, search, work

MODULES = (search, memory, relations, work, cost, journal, lens)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.Q.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
