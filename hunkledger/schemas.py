"""Schemas of the tables that enter and leave the operators."""

from __future__ import annotations

DIFFS = "scan_id bigint, repo string, scan_ts timestamp, raw string"

FIX = "struct<fixed_line:string,explanation:string,automated:boolean>"
WIRE_FINDING = (
    "struct<id:string,severity:string,vuln_class:string,description:string,"
    "line_number:bigint,code_snippet:string,confidence:double,cwe:string,"
    f"fix:{FIX}>"
)

AUDIT_TEXT_FIELDS = (
    "timestamp", "action", "rule_id", "path", "severity", "source", "message", "reason",
    "patch_hash",
)
AUDIT_COLUMNS = (
    "repo", "log_seq", "timestamp", "action", "rule_id", "path", "line", "severity", "source",
    "message", "reason", "patch_hash",
)

# Position of a finding inside its scan.  Phase 1 findings come before Phase 2 findings.
FINDING_ORDER = ("phase", "file_ord", "hunk_ord", "line_ord", "rule_ord")

FINDING_DEFAULTS: dict[str, tuple[str, object]] = {
    "scan_id": ("bigint", None),
    "phase": ("int", None),
    "file_ord": ("int", None),
    "hunk_ord": ("int", 0),
    "line_ord": ("int", 0),
    "rule_ord": ("int", 0),
    "rule_id": ("string", ""),
    "path": ("string", ""),
    "line": ("bigint", 0),
    "column": ("bigint", 0),
    "end_line": ("bigint", 0),
    "end_column": ("bigint", 0),
    "message": ("string", ""),
    "severity": ("int", 0),
    "content": ("string", ""),
    "source": ("string", ""),
    "confidence": ("double", 0.0),
    "patch": ("string", ""),
    "llm_id": ("string", ""),
    "vuln_class": ("string", ""),
    "cwe": ("string", ""),
    "auto_fixable": ("boolean", False),
    "fixed_line": ("string", ""),
    "fix_explain": ("string", ""),
    "latency_ms": ("bigint", 0),
}
FINDING_COLUMNS = tuple(FINDING_DEFAULTS)
# The finding's own fields, in the order of its JSON form.
FINDING_FIELDS = FINDING_COLUMNS[6:]

#: ``log_date`` of entries without a valid time.
UNDATED = "undated"
