"""Audit report: window, breakdowns, top rules, bypass history, trend, JSON, bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalogue import BAR_WIDTH, REPORT_DAYS, TOP_RULES
from ..functions.times import parse_rfc3339, rfc3339
from ..schemas import UNDATED

DIMENSIONS = ("severity", "action", "rule_id", "source")
TREND_BUCKET = 1 << 20
TREND_PLACE = ("repo", "part", "bucket")


def audit_window(audit: DataFrame, as_of: Column, days: int = REPORT_DAYS) -> DataFrame:
    """Entries with a valid time strictly after ``as_of`` minus ``days`` calendar days.

    A log with a ``log_date`` column, as ``write_audit`` divides it (the UTC day of the time, or
    ``UNDATED``), is read from the day before the cutoff's on: that day is compared as it stands, so
    Spark prunes the folders.  The day's slack covers a session in another time zone.
    """
    cutoff = as_of - F.make_interval(days=F.lit(days))
    if "log_date" in audit.columns:
        first = F.date_format(F.date_sub(F.to_date(cutoff), 1), "yyyy-MM-dd")
        audit = audit.where((F.col("log_date") >= first) & (F.col("log_date") != UNDATED))
    return audit.where(parse_rfc3339(F.col("timestamp")) > cutoff)


def entry_counts(window: DataFrame) -> DataFrame:
    """Entries per repository and combination of the four dimensions.

    The breakdowns read this small table, so the log itself is aggregated once.
    """
    return window.groupBy("repo", *DIMENSIONS).agg(F.count(F.lit(1)).alias("n"))


def audit_breakdown(counts: DataFrame) -> DataFrame:
    """Counts by severity, action, rule and source, and the total, per repository."""
    sets = counts.groupingSets(
        [*[[F.col("repo"), F.col(d)] for d in DIMENSIONS], [F.col("repo")]],
        "repo",
        *DIMENSIONS,
    ).agg(F.sum("n").alias("n"), F.grouping_id().alias("_g"))
    # grouping_id bits, from the left: repo, then the dimensions; a set bit is rolled up.
    full = (1 << len(DIMENSIONS)) - 1
    which = {full - (1 << (len(DIMENSIONS) - 1 - i)): d for i, d in enumerate(DIMENSIONS)}
    dimension = F.lit("total")
    value = F.lit("")
    for bits, name in which.items():
        dimension = F.when(F.col("_g") == bits, F.lit(name)).otherwise(dimension)
        value = F.when(F.col("_g") == bits, F.col(name)).otherwise(value)
    return sets.select("repo", dimension.alias("dimension"), value.alias("value"), "n")


def top_rules(counts: DataFrame, k: int = TOP_RULES) -> DataFrame:
    """The ``k`` most frequent rules per repository; equal counts by rule id.

    The rank filter limits each task before the shuffle, so a repository with very many
    rules sends at most ``k`` rows per task.
    """
    per_rule = counts.groupBy("repo", "rule_id").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("repo").orderBy(F.desc("n"), "rule_id")
    return per_rule.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bypass_history(counts: DataFrame) -> DataFrame:
    """Bypasses and skipped hooks per repository."""

    def of(action: str) -> Column:
        return F.sum(F.when(F.col("action") == action, F.col("n")).otherwise(0))

    return counts.groupBy("repo").agg(
        F.sum("n").alias("total_events"),
        of("bypass").alias("bypass_count"),
        of("no-verify").alias("no_verify_count"),
    )


def trend_rows(window: DataFrame, bucket: int = TREND_BUCKET) -> DataFrame:
    """Entries with the range they fall in: ``bucket`` log numbers, or an hour where there is no number."""
    severe = F.col("severity").isin("CRITICAL", "ERROR")
    moment = F.lit(None).cast("timestamp")
    if "timestamp" in window.columns:
        moment = parse_rfc3339(F.col("timestamp"))
    numbered = F.col("log_seq").isNotNull()
    hour = F.floor(F.unix_seconds(moment) / 3600)
    return window.select(
        *[c for c in ("log_date",) if c in window.columns],
        "repo", "log_seq", "severity", moment.alias("moment"), severe.alias("severe"),
        F.when(numbered, 0).otherwise(1).alias("part"),
        F.coalesce(
            F.when(numbered, F.floor(F.col("log_seq") / F.lit(bucket))).otherwise(hour), F.lit(0)
        ).cast("bigint").alias("bucket"),
    )


def bucket_counts(rows: DataFrame, *more: str) -> DataFrame:
    """Entries and blocking ones per range; the counts of parts of a log add up."""
    return rows.groupBy(*more, *TREND_PLACE).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("severe").alias("s")
    )


def middle_buckets(per_bucket: DataFrame) -> DataFrame:
    """The one range of each repository that holds the middle of its log."""
    by_repo = Window.partitionBy("repo")
    before = by_repo.orderBy("part", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_bucket.select(
        *TREND_PLACE, "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s_before"),
        F.sum("n").over(by_repo).alias("n_all"),
        F.sum("s").over(by_repo).alias("s_all"),
    ).withColumn("mid", F.floor(F.col("n_all") / 2).cast("bigint"))
    return placed.where(
        (F.col("mid") >= F.col("n_before")) & (F.col("mid") < F.col("n_before") + F.col("n"))
    )


def trend_of(middle: DataFrame, rows: DataFrame) -> DataFrame:
    """The trend from the middle ranges; of ``rows`` only those in one of them count."""
    in_bucket = Window.partitionBy(*TREND_PLACE).orderBy("log_seq", "moment", "severity")
    partly = (
        rows.join(middle.select(*TREND_PLACE, "mid", "n_before"), list(TREND_PLACE))
        .withColumn("_at", F.row_number().over(in_bucket) + F.col("n_before"))
        .groupBy("repo")
        .agg(F.count_if(F.col("severe") & (F.col("_at") <= F.col("mid"))).alias("s_part"))
    )
    halves = middle.join(partly, "repo").select(
        "repo", F.col("n_all").alias("total"),
        (F.col("s_before") + F.col("s_part")).alias("first_half"),
        (F.col("s_all") - F.col("s_before") - F.col("s_part")).alias("second_half"),
    )
    label = (
        F.when(F.col("total") < 2, F.lit("STABLE"))
        .when(F.col("second_half") > F.col("first_half"), F.lit("WORSENING"))
        .when(F.col("second_half") < F.col("first_half"), F.lit("IMPROVING"))
        .otherwise(F.lit("STABLE"))
    )
    return halves.select("repo", "total", "first_half", "second_half", label.alias("trend"))


def trend(window: DataFrame, bucket: int = TREND_BUCKET) -> DataFrame:
    """Blocking severities in the first half of the log against the rest.

    The halves are by position, ``floor(n/2)`` rows first.  Rows with a log number come in
    its order, then those without one by time; what remains equal differs in nothing that is counted
    but the severity, which decides.  No window spans a whole repository: ranges of ``bucket``
    log numbers, or of an hour, are counted first, and only the one range that holds the
    middle is ranked row by row.
    """
    rows = trend_rows(window, bucket)
    return trend_of(middle_buckets(bucket_counts(rows)), rows)


def _count_maps(breakdown: DataFrame, names: dict[str, str]) -> DataFrame:
    """A map from value to count per repository and wanted dimension, in one aggregate."""

    def of(dimension: str) -> Column:
        pair = F.when(F.col("dimension") == dimension, F.struct("value", "n"))
        return F.map_from_entries(F.array_sort(F.collect_list(pair)))

    wanted = breakdown.where(F.col("dimension").isin(*names))
    return wanted.groupBy("repo").agg(*[of(d).alias(name) for d, name in names.items()])


def report(window: DataFrame, as_of: Column, days: int = REPORT_DAYS) -> DataFrame:
    """One report row per repository with entries in the window."""
    return report_of(entry_counts(window), trend(window), as_of, days)


def report_of(counts: DataFrame, trends: DataFrame, as_of: Column, days: int) -> DataFrame:
    """The report from entry counts, which may be divided further, and trends."""
    maps = _count_maps(
        audit_breakdown(counts), {"severity": "severity", "action": "actions", "source": "sources"}
    )
    top = (
        top_rules(counts)
        .groupBy("repo")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "rule_id", "n"))).alias("_top"))
        .select(
            "repo",
            F.transform(
                "_top", lambda r: F.struct(r["rule_id"].alias("rule"), r["n"].alias("count"))
            ).alias("top_rules"),
        )
    )
    return (
        bypass_history(counts)
        .join(trends.select("repo", "trend"), "repo", "left")
        .join(top, "repo", "left")
        .join(maps, "repo", "left")
        .select(
            "repo",
            rfc3339(as_of).alias("generated_at"),
            F.lit(days).alias("period_days"),
            "total_events", "severity", "actions", "top_rules", "sources", "bypass_count",
            "no_verify_count", "trend",
        )
    )


def report_json(reports: DataFrame) -> DataFrame:
    """The report of each repository as JSON text."""
    fields = [c for c in reports.columns if c != "repo"]
    return reports.select("repo", F.to_json(F.struct(*fields)).alias("report"))


def report_bars(breakdown: DataFrame, width: int = BAR_WIDTH) -> DataFrame:
    """A bar per severity present: its share of the repository's entries, at least one
    block, in fixed order from CRITICAL to INFO."""
    order = F.array(*[F.lit(s) for s in ("CRITICAL", "ERROR", "WARNING", "INFO")])
    position = F.array_position(order, F.col("value"))
    severities = breakdown.where((F.col("dimension") == "severity") & (position > 0))
    totals = breakdown.where(F.col("dimension") == "total").select("repo", F.col("n").alias("total"))
    filled = F.greatest(F.floor(F.col("n") * width / F.col("total")), F.lit(1)).cast("int")
    return severities.join(totals, "repo").select(
        "repo",
        position.cast("int").alias("position"),
        F.col("value").alias("severity"),
        "n",
        F.concat(
            F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled)
        ).alias("bar"),
    )
