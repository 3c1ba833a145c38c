"""Findings as JSON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import FINDING_FIELDS


def write_findings(findings: DataFrame, scans: DataFrame, path: str) -> None:
    """One JSON object per finding (its scan, then its fields; severity is a number), one folder
    per repository.  ``scans``: scan_id, repo."""
    row = F.to_json(F.struct("scan_id", *FINDING_FIELDS))
    placed = findings.join(scans.select("scan_id", "repo"), "scan_id")
    lines = placed.select("repo", row.alias("value")).hint("rebalance", "repo")
    lines.write.mode("append").partitionBy("repo").text(path)
