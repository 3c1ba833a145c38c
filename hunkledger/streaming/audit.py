"""Audit log as a stream: decoded lines, entries as a table, counts per day and per sliding month.

Log files grow by append, so they are read by byte (``sources/tail.py``): a line appended to a file that was already read is new input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import parse_rfc3339
from ..schemas import AUDIT_COLUMNS
from ..sources.audit import decode_audit
from ..sources.tail import repo_of, tail_lines

WATERMARK = "1 day"
_SEVERAL_BATCHES = "spark.sql.streaming.triggerAvailableNowWrapper.enabled"


def streaming_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of the given one, whose streams run until nothing is left to do.  Otherwise Spark stops after one batch
    where a source is not one of its own, before the windows that this batch closed are written."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set(_SEVERAL_BATCHES, "true")
    return own


def stream_audit(spark: SparkSession, path: str) -> DataFrame:
    """Stream of audit entries with their event time, from a ``write_audit`` folder or plain logs."""
    lines = tail_lines(spark, path)
    return (
        decode_audit(lines.select(repo_of(F.col("file")).alias("repo"), "value"))
        .withColumn("event_time", parse_rfc3339(F.col("timestamp")))
        .where(F.col("event_time").isNotNull())
    )


def tail_audit(spark: SparkSession, in_path: str, out_path: str, checkpoint: str) -> StreamingQuery:
    """Append the new entries of plain logs (one ``<repo>/audit.jsonl`` each) to a parquet table.

    ``log_seq`` is the byte a line starts at.  Reruns with the same checkpoint take up where the last one ended, in the
    middle of a file too.
    """
    lines = tail_lines(streaming_session(spark), in_path).select(repo_of(F.col("file")).alias("repo"), F.col("place").alias("log_seq"), "value")
    return (
        decode_audit(lines).select(*AUDIT_COLUMNS).writeStream.outputMode("append").format("parquet").option("path", out_path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def daily_counts(entries: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Entries per repository, severity and day; rows behind the watermark drop out."""
    return (
        entries.withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", "1 day"), "repo", "severity")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def monthly_counts(daily: DataFrame) -> DataFrame:
    """Sliding 30-day sums, one per day, fed from the daily counts.

    Summing daily counts multiplies one row per day and group by thirty, not every
    entry.
    """
    return daily.groupBy(
        F.window(F.window_time("window"), "30 days", "1 day"), "repo", "severity"
    ).agg(F.sum("n").alias("n"))


def _flat(counts: DataFrame) -> DataFrame:
    return counts.select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), "repo",
        "severity", "n",
    )


def audit_stream(
    spark: SparkSession, in_path: str, out_path: str, checkpoint: str, watermark: str = WATERMARK
) -> list[StreamingQuery]:
    """Ingest what is new in ``in_path`` and append closed windows below ``out_path``:
    ``daily`` and ``monthly``.  Reruns with the same checkpoint continue where they left."""
    daily = daily_counts(stream_audit(streaming_session(spark), in_path), watermark)
    outputs = {"daily": _flat(daily), "monthly": _flat(monthly_counts(daily))}
    return [
        table.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{out_path}/{name}")
        .option("checkpointLocation", f"{checkpoint}/{name}")
        .trigger(availableNow=True)
        .start()
        for name, table in outputs.items()
    ]
