"""File filter and added-line selection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogue import BLOCKED_EXTENSIONS
from ..functions.text import path_ext


def filter_blocked(files: DataFrame, blocked: Iterable[str] = BLOCKED_EXTENSIONS) -> DataFrame:
    """Drop files whose extension (from its last dot, case-sensitive) is blocked."""
    blocked = list(blocked)
    if not blocked:
        return files
    return files.where(~path_ext(F.col("path")).isin(*blocked))


def added_lines(files: DataFrame) -> DataFrame:
    """Added lines of file rows (see ``diffs.with_added``), one row each."""
    place = [c for c in ("scan_id", "file_ord", "path") if c in files.columns]
    lines = files.select(*place, F.explode_outer("added").alias("_line"))
    return (
        lines.where(F.col("_line").isNotNull()).select(*place, "_line.*").drop("suppressed")
    )


def added_counts(files: DataFrame) -> DataFrame:
    """Number of added lines per file; counted inside each file row."""
    return files.select("scan_id", "file_ord", "path", F.size("added").alias("n_added"))
