"""The report from daily partial counts, kept up with the log.

A day of the log is counted once, into two small tables: entries per repository and combination of the report's four dimensions, and
entries per range of log numbers for the trend.  Both add up over days.  A report reads them for the whole days of its window, and from the
log itself only two things: the day that the window's beginning cuts, and the days that hold the middle of some repository's
log, of which the one range around the middle is ranked.

The log must be divided by day (``write_audit``), and its files never change, though a day may get new ones.  A day is counted
again, and its partition replaced, when its files are not those it was counted from; nothing is added to a stored count, so a run
that was ended halfway can be started again.  A day deleted from the log keeps its counts.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import PERIODIC_DAYS
from ..functions.times import parse_rfc3339, rfc3339
from ..operators.report import (
    audit_window, bucket_counts, entry_counts, middle_buckets, report_of, trend_of, trend_rows,
)
from ..schemas import UNDATED
from ..session import drop_stage, stage
from ..sources.audit import read_audit
from .report import moment_of

_DAY = r"/log_date=([0-9]{4}-[0-9]{2}-[0-9]{2})/"
_COUNTS = "log_date string, repo string, severity string, action string, rule_id string, source string, n bigint"
_RANGES = "log_date string, repo string, part int, bucket bigint, n bigint, s bigint"
_STAMPS = "log_date string, n_files bigint, n_bytes bigint, newest timestamp"
#: A stored range is 2^10 log numbers, or an hour; the middle is first sought among 2^10 of them at once.
_FINE, _COARSE_BITS = 1 << 10, 10
_ENTRY = ("log_date", "repo", "log_seq", "timestamp", "severity", "action", "rule_id", "source")


def _table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A partial table; empty if it was never written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def _replace_days(table: DataFrame, path: str, name: str) -> None:
    """Write the days in ``table``; other days stay as they are."""
    (
        table.repartition("log_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("log_date").parquet(f"{path}/{name}")
    )


def _stamps(spark: SparkSession, audit_path: str) -> DataFrame:
    """What files each day of the log has; lists files without opening them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(audit_path)
    return (
        files.select(F.regexp_extract("path", _DAY, 1).alias("log_date"), "length", "modificationTime")
        .where(F.col("log_date") != "")
        .groupBy("log_date")
        .agg(
            F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"), F.max("modificationTime").alias("newest"),
        )
    )


def refresh_partials(spark: SparkSession, audit_path: str, partials_path: str) -> list[str]:
    """Count the days whose files have changed since they were counted; returns those days.

    The driver sees one row for each changed day, nothing of the log.  The files are listed before they are read, so a file that comes in
    between makes its day count as changed next time.
    """
    same = ["log_date", "n_files", "n_bytes", "newest"]
    changed = _stamps(spark, audit_path).join(_table(spark, partials_path, "stamps", _STAMPS), same, "left_anti").collect()
    days = sorted(r["log_date"] for r in changed)
    if not days:
        return days
    log = read_audit(spark, audit_path, dated=True).where(F.col("log_date").isin(days))
    entries, staged = stage(log.where(parse_rfc3339(F.col("timestamp")).isNotNull()).select(*_ENTRY), "partial-entries")
    counts = entries.groupBy("log_date", "repo", "severity", "action", "rule_id", "source").agg(F.count(F.lit(1)).alias("n"))
    _replace_days(counts, partials_path, "counts")
    _replace_days(bucket_counts(trend_rows(entries, _FINE), "log_date"), partials_path, "ranges")
    # Last, so that days are counted again if a run ends before this.
    _replace_days(spark.createDataFrame(changed, _STAMPS), partials_path, "stamps")
    drop_stage(spark, staged)
    return days


def _cut_day(spark: SparkSession, as_of: datetime, days: int) -> str:
    """The UTC day in which the window begins."""
    cutoff = moment_of(as_of) - F.make_interval(days=F.lit(days))
    return spark.range(1).select(F.left(rfc3339(cutoff), F.lit(10))).first()[0]


def _middle_ranges(ranges: DataFrame) -> DataFrame:
    """The stored range that holds the middle of each repository's log, in two steps, so that no window holds all ranges of a
    repository."""
    summed = ranges.groupBy("repo", "part", "bucket").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    wide = F.shiftright("bucket", _COARSE_BITS)
    coarse = middle_buckets(
        summed.groupBy("repo", "part", wide.alias("bucket")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    ).withColumnRenamed("bucket", "wide").drop("n")
    before = Window.partitionBy("repo").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)

    def so_far(count: str):
        return (F.col(f"{count}_before") + F.coalesce(F.sum(count).over(before), F.lit(0))).alias(f"{count}_before")

    inside = summed.withColumn("wide", wide).join(coarse, ["repo", "part", "wide"])
    placed = inside.select("repo", "part", "bucket", "n", so_far("n"), so_far("s"), "n_all", "s_all", "mid")
    return placed.where((F.col("mid") >= F.col("n_before")) & (F.col("mid") < F.col("n_before") + F.col("n")))


def report_from_partials(
    spark: SparkSession, audit_path: str, partials_path: str, out_path: str, as_of: datetime, days: int = PERIODIC_DAYS
) -> list[str]:
    """Write what ``periodic_report`` writes, from the partials as last refreshed; returns the days of the log that were read."""
    target = f"{out_path.rstrip('/')}/as_of={as_of:%Y-%m-%d}"
    cut = _cut_day(spark, as_of, days)
    log = read_audit(spark, audit_path, dated=True).where(F.col("log_date") != UNDATED).select(*_ENTRY)
    edge, edge_path = stage(audit_window(log.where(F.col("log_date") == cut), moment_of(as_of), days), "report-edge")

    later = F.col("log_date") > cut
    edge_rows = trend_rows(edge, _FINE)
    ranges = _table(spark, partials_path, "ranges", _RANGES).where(later).unionByName(bucket_counts(edge_rows, "log_date"))
    middle, middle_path = stage(_middle_ranges(ranges), "report-middle")
    # At most one value for each day of the window reaches the driver.
    held = ranges.where(later).join(middle, ["repo", "part", "bucket"], "left_semi").select("log_date").distinct().collect()
    middle_days = sorted(r["log_date"] for r in held)
    rows = edge_rows.unionByName(trend_rows(log.where(F.col("log_date").isin(middle_days)), _FINE))

    counts = _table(spark, partials_path, "counts", _COUNTS).where(later).drop("log_date").unionByName(entry_counts(edge))
    report_of(counts, trend_of(middle, rows), moment_of(as_of), days).write.mode("overwrite").parquet(target)
    drop_stage(spark, edge_path)
    drop_stage(spark, middle_path)
    return sorted({cut, *middle_days})
