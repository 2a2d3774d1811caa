"""Queries over the given tables, one per operator, with SQL twins where SQL can say it."""

from __future__ import annotations

from importlib import import_module

AREAS = (
    "text_rows", "retrieval", "fusion", "scoping", "log_stats", "entry_tables", "replays", "sweeps", "health",
    "evaluation", "streams",
)


def load():
    """Import every area and return (queries, sql)."""
    from rankloom.catalog import base

    for area in AREAS:
        import_module(f"rankloom.catalog.{area}")
    return base.QUERIES, base.SQL
