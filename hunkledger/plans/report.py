"""The periodic report job: one dated partition per run, overwritten on a rerun."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import PERIODIC_DAYS
from ..operators.report import audit_window, report
from ..session import drop_stage, stage
from ..sources.audit import read_audit, read_plain_audit


def build_report(audit: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """One report row per repository over the ``days`` before ``as_of`` (UTC)."""
    return report(audit_window(audit, moment_of(as_of), days), moment_of(as_of), days)


def moment_utc(as_of: datetime) -> datetime:
    return (as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)


def moment_of(as_of: datetime) -> Column:
    return F.timestamp_seconds(F.lit(int(moment_utc(as_of).timestamp())))


def periodic_report(
    spark: SparkSession,
    audit_path: str,
    out_path: str,
    as_of: datetime,
    days: int = PERIODIC_DAYS,
    plain: bool = False,
) -> str:
    """Write the report of the last ``days`` to ``<out_path>/as_of=<date>``; returns that
    path.  Only this run's partition is replaced.  ``plain``: the log is as the command-line
    tool keeps it, one ``<repo>/audit.jsonl`` each."""
    target = f"{out_path.rstrip('/')}/as_of={as_of:%Y-%m-%d}"
    # The breakdowns and the trend both read the entries: decode the JSON once, and keep
    # only what the report covers.
    log = read_plain_audit(spark, audit_path) if plain else read_audit(spark, audit_path, dated=True)
    entries = audit_window(log, moment_of(as_of), days).select(
        "repo", "log_seq", "timestamp", "severity", "action", "rule_id", "source"
    )
    staged, path = stage(entries, "report-entries")
    report(staged, moment_of(as_of), days).write.mode("overwrite").parquet(target)
    drop_stage(spark, path)
    return target
