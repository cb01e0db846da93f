"""All named queries of the core and their SQL twins."""

from __future__ import annotations

from . import assembly, catalog, general, io, judging, services, tables

MODULES = [general, assembly, judging, catalog, tables, io, services]
FLAGSHIP = "AGG-01"


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.oracle_sql().items()}
