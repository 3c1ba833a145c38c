"""SQL text helpers, written for DuckDB."""

from __future__ import annotations

WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(5760)||" + "||".join(
    f"chr({c})" for c in [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def trim(e: str) -> str:
    return f"trim({e}, {WS})"


def path_ext(p: str) -> str:
    return f"regexp_extract({p}, '(\\.[^./]*)$', 1)"


def last_dot_ext(p: str) -> str:
    return f"regexp_extract({p}, '(?s)(\\.[^.]*)$', 1)"


def sev_rank(e: str) -> str:
    return f"CASE {e} WHEN 'WARNING' THEN 1 WHEN 'ERROR' THEN 2 WHEN 'CRITICAL' THEN 3 ELSE 0 END"


def sev_name(e: str) -> str:
    return f"CASE {e} WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'CRITICAL' ELSE 'UNKNOWN' END"
