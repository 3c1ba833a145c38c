"""SQL oracles: the registered queries written again, as SQL for DuckDB."""

from __future__ import annotations


def all_queries() -> dict[str, str]:
    from . import agents_sql, audit_sql, files_sql, scan_sql
    from .core import with_blocks

    out: dict[str, str] = {}
    for module in (scan_sql, agents_sql, audit_sql, files_sql):
        out.update({k: with_blocks(q) for k, q in module.QUERIES.items()})
    return out
