"""Bypass tokens, the scans that consume them, and the audit rows both leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import rfc3339

BUCKET_SECONDS = 60


def _stamp(c: Column) -> Column:
    return F.unix_micros(c).cast("string")


def bypass_tokens(issues: DataFrame) -> DataFrame:
    """Tokens from issue events; an empty reason is rejected (see ``rejected_issues``)."""
    digest = F.sha2(F.concat_ws("|", "repo", "reason", _stamp(F.col("created_at"))), 256)
    return issues.where(F.col("reason") != "").select(
        "repo",
        F.left(digest, F.lit(16)).alias("id"),
        "reason",
        "created_at",
        (F.col("created_at") + F.make_interval(hours=F.col("ttl_hours"))).alias("expires_at"),
    )


def rejected_issues(issues: DataFrame) -> DataFrame:
    return issues.where(F.coalesce(F.col("reason"), F.lit("")) == "")


def bypass_match(
    tokens: DataFrame, scans: DataFrame, bucket_seconds: int = BUCKET_SECONDS
) -> DataFrame:
    """The scan that consumes each token.

    A repository holds one token: a new one replaces it, and the first scan after its
    creation uses it up, or clears it if it has expired.  So a token goes to the first
    scan at or after its creation and before the next token, if not past its expiry.

    As-of join without a window over a whole repository: equal times collapse first, so
    a (repository, time bucket) holds at most one row per microsecond and side; inside a
    bucket the last token is carried forward, and between buckets only one row per
    bucket takes part.
    """
    # At equal times the last-issued token is the one in the file.
    token = tokens.groupBy("repo", F.col("created_at").alias("ts")).agg(
        F.max(F.struct("expires_at", "id", "reason")).alias("token")
    )
    scan = scans.groupBy("repo", F.col("scan_ts").alias("ts")).agg(
        F.min("scan_id").alias("scan_id")
    )
    token_type = token.schema["token"].dataType
    stamped = F.struct(F.col("ts").alias("created_at"), "token.*")
    rows = (
        token.select("repo", "ts", F.lit(0).alias("side"), stamped.alias("token"),
                     F.lit(None).cast("bigint").alias("scan_id"))
        .unionByName(
            scan.select("repo", "ts", F.lit(1).alias("side"),
                        F.lit(None).cast(_stamped_type(token_type)).alias("token"), "scan_id")
        )
        .withColumn(
            "bucket", F.floor(F.unix_micros("ts") / F.lit(bucket_seconds * 1_000_000)).cast("bigint")
        )
    )
    # Token before scan at equal times.
    inside = Window.partitionBy("repo", "bucket").orderBy("ts", "side")
    carried = rows.select(
        "repo", "bucket", "ts", "side", "scan_id",
        F.last("token", ignorenulls=True).over(inside).alias("token"),
    )
    scans_in = carried.where("side = 1")
    within = scans_in.where(F.col("token").isNotNull()).select("repo", "ts", "scan_id", "token")

    # Per bucket: its first scan ahead of any token of the bucket, and its last token.
    per_bucket = carried.groupBy("repo", "bucket").agg(
        F.min(
            F.when(
                (F.col("side") == 1) & F.col("token").isNull(), F.struct("ts", "scan_id")
            )
        ).alias("first_scan"),
        F.max_by("token", F.when(F.col("side") == 0, F.col("ts"))).alias("last_token"),
    )
    earlier = (
        Window.partitionBy("repo").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    across = (
        per_bucket.withColumn("token", F.last("last_token", ignorenulls=True).over(earlier))
        .where(F.col("first_scan").isNotNull() & F.col("token").isNotNull())
        .select("repo", "first_scan.ts", "first_scan.scan_id", "token")
    )
    first = (
        within.unionByName(across)
        .groupBy("repo", "token")
        .agg(F.min(F.struct("ts", "scan_id")).alias("scan"))
    )
    return first.where(F.col("scan.ts") <= F.col("token.expires_at")).select(
        "scan.scan_id",
        "repo",
        F.col("scan.ts").alias("scan_ts"),
        F.col("token.id").alias("token_id"),
        F.col("token.reason").alias("reason"),
        F.col("token.created_at").alias("created_at"),
        F.col("token.expires_at").alias("expires_at"),
    )


def _stamped_type(token_type) -> str:
    inner = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in token_type.fields)
    return f"struct<created_at:timestamp,{inner}>"


def _audit_row(df: DataFrame, **columns: Column) -> DataFrame:
    names = (
        "timestamp", "action", "rule_id", "path", "line", "severity", "source", "message",
        "reason", "patch_hash",
    )
    zero = {"line": F.lit(0).cast("bigint")}
    return df.select(
        "repo", *[columns.get(n, zero.get(n, F.lit(""))).alias(n) for n in names]
    )


def bypass_audit(matches: DataFrame) -> DataFrame:
    """Audit row of each consumed token."""
    return _audit_row(
        matches,
        timestamp=rfc3339(F.col("scan_ts")),
        action=F.lit("bypass"),
        rule_id=F.concat(F.lit("bypass-"), F.col("token_id")),
        severity=F.lit("INFO"),
        message=F.col("reason"),
    )


def unscanned_commits(commits: DataFrame, scans: DataFrame) -> DataFrame:
    """Audit row of each commit without a scan record in its repository."""
    missing = commits.join(scans.select("repo", "commit"), ["repo", "commit"], "left_anti")
    return _audit_row(
        missing,
        timestamp=rfc3339(F.col("ts")),
        action=F.lit("no-verify"),
        rule_id=F.lit("hook-bypass"),
        severity=F.lit("WARNING"),
        source=F.lit("post-commit-hook"),
        message=F.concat(
            F.lit("commit "), F.col("commit"), F.lit(" by "), F.col("author"),
            F.lit(" skipped pre-commit hook (--no-verify)"),
        ),
    )
