"""Named queries by subject, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from importlib import import_module

SUBJECTS = ["incremental", "relational", "graph", "search", "changes", "program", "tools"]


def catalogue() -> tuple[dict, dict]:
    """All named queries of the core and their SQL."""
    queries, oracle = {}, {}
    for name in SUBJECTS:
        module = import_module(f"{__name__}.{name}")
        queries |= module.QUERIES
        oracle |= module.ORACLE
    return queries, oracle
