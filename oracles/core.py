"""Named SQL building blocks for the oracles, joined into WITH chains on demand."""

from __future__ import annotations

import re

BLOCKS: dict[str, str] = {}


def block(name: str, sql: str) -> None:
    BLOCKS[name] = sql


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in values) + "]"


def with_blocks(select: str) -> str:
    """``select`` preceded by every block it names, directly or through other blocks."""
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in BLOCKS:
            if name not in ordered and re.search(rf"\b{name}\b", sql):
                visit(BLOCKS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(select)
    if not ordered:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({BLOCKS[n]})" for n in ordered) + "\n" + select
