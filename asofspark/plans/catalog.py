"""The registered queries and their SQL."""

from __future__ import annotations

from . import core, ingest, master, models, sinks

AREAS = (core, master, models, ingest, sinks)


def queries() -> dict:
    return {name: f for area in AREAS for name, f in area.query.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in AREAS for name, sql in area.query.sql.items()}
