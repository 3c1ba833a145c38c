"""New diffs as a stream: each micro-batch runs the batch scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.post import scan_verdict, severity_counts
from ..plans.scan import ScanInputs, ScanOptions, ScanResult, file_digest, run_scan, scan_of_digest
from ..schemas import DIFFS
from ..session import drop_stage, stage
from .audit import streaming_session

#: A scanner's report on one scan, and the recorded answers of its agents, with when they came.
REPORTS = "scan_id bigint, available boolean, exit_code int, report string, report_ts timestamp"
ANSWER = (
    "file_ord int, file_path string, agent_ord int, agent string, provider string, available boolean, "
    "http_status int, body string, latency_ms bigint"
)
ANSWERS = f"scan_id bigint, answers array<struct<{ANSWER}>>, answers_ts timestamp"
#: How far behind the newest time an input may arrive, and how long a scan waits for its report and answers.
WATERMARK, WAIT = "10 minutes", "1 hour"


def _of_batch(ids: DataFrame, others: ScanInputs) -> ScanInputs:
    """The rows of a batch's own scans."""
    own = {
        f.name: table.join(ids, "scan_id", "left_semi")
        for f in fields(ScanInputs)
        if f.name not in ("diffs", "ignores") and (table := getattr(others, f.name)) is not None
    }
    return replace(others, **own)


def _write(result: ScanResult, inputs: ScanInputs, out_path: str, batch_id: int) -> None:
    """Findings and verdicts of one batch; a batch that runs twice replaces its own partition."""
    part = f"batch_id={batch_id}"
    result.findings.write.mode("overwrite").parquet(f"{out_path}/findings/{part}")
    # The verdicts read the findings just written instead of computing them again.
    spark = result.findings.sparkSession
    written = spark.read.schema(result.findings.schema).parquet(f"{out_path}/findings/{part}")
    verdicts = scan_verdict(result.scans, severity_counts(written), inputs.bypassed, inputs.config_errors)
    verdicts.write.mode("overwrite").parquet(f"{out_path}/verdicts/{part}")
    result.release()


def _start(rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def scan_stream(
    spark: SparkSession,
    in_path: str,
    out_path: str,
    checkpoint: str,
    options: ScanOptions = ScanOptions(),
    files_per_batch: int = 1000,
    others: ScanInputs | None = None,
) -> StreamingQuery:
    """Scan diffs as they arrive in ``in_path`` (parquet) and write ``findings`` and
    ``verdicts`` below ``out_path``, one partition per batch id.

    ``others`` brings the tables beside the diffs (reports, responses, bypassed scans,
    configuration errors, ignores); each batch takes the rows of its own scans.

    A scan is one input row, so batches are independent.  A batch that runs twice
    replaces its own partition and leaves no duplicates.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        inputs = ScanInputs() if others is None else _of_batch(batch.select("scan_id").distinct(), others)
        _write(run_scan(replace(inputs, diffs=batch), options, keep_findings=False), inputs, out_path, batch_id)

    stream = (
        spark.readStream.schema(DIFFS).option("maxFilesPerTrigger", files_per_batch).parquet(in_path)
    )
    return _start(stream, handle, checkpoint)


def with_late_inputs(
    digest: DataFrame, reports: DataFrame, answers: DataFrame, watermark: str = WATERMARK, wait: str = WAIT
) -> DataFrame:
    """Digest rows of a stream of diffs, each scan's as soon as its report and its answers are there, or when the watermark
    has passed the time it waits for them.  ``report`` and ``answers`` come with the scan's own row (``file_ord`` 0), NULL if they never came.

    Two outer joins of streams.  Their state holds digest rows, not diffs, of the scans that wait, and reports and answers that may still
    meet a scan.  What comes later than ``wait`` after its scan is not used.
    """
    span = F.expr(f"INTERVAL {wait}")

    def joined(rows: DataFrame, other: DataFrame, value: str, at: str) -> DataFrame:
        payload = [c for c in other.columns if c not in ("scan_id", at)]
        late = other.withWatermark(at, watermark).select(
            F.col("scan_id").alias("_id"), F.col(at), F.struct(*payload).alias("_payload") if len(payload) > 1 else F.col(payload[0]).alias("_payload")
        )
        near = (F.col("scan_id") == F.col("_id")) & F.col(at).between(F.col("scan_ts"), F.col("scan_ts") + span)
        own = F.when(F.col("file_ord") == 0, F.col("_payload")).alias(value)
        return rows.join(late, near, "left_outer").select(*rows.columns, own)

    rows = digest.withWatermark("scan_ts", watermark)
    return joined(joined(rows, reports, "report", "report_ts"), answers, "answers", "answers_ts")


def late_scan_stream(
    spark: SparkSession,
    diffs_path: str,
    reports_path: str,
    answers_path: str,
    out_path: str,
    checkpoint: str,
    options: ScanOptions = ScanOptions(),
    watermark: str = WATERMARK,
    wait: str = WAIT,
    files_per_batch: int = 1000,
    others: ScanInputs | None = None,
) -> StreamingQuery:
    """Scan diffs whose reports (``REPORTS``) and answers (``ANSWERS``, one row for each scan) arrive as streams of their own, before or after them.

    A scan's verdict is written once, with what came in time; without a report its rules count.  The newest time of all three streams
    moves the watermark, so a stream that stands still holds no scan back.  ``others`` brings what is at rest: bypassed scans,
    configuration errors, ignores.
    """
    own = streaming_session(spark)
    own.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "max")

    def read(schema: str, path: str) -> DataFrame:
        return own.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        digest, path = stage(batch, "digest")
        if digest.isEmpty():  # only the watermark has moved
            return drop_stage(digest.sparkSession, path)
        scans = digest.where("file_ord = 0")
        inputs = ScanInputs() if others is None else _of_batch(scans.select("scan_id"), others)
        reports = scans.where("report IS NOT NULL").select("scan_id", "report.*")
        answers = scans.select("scan_id", F.explode("answers").alias("a")).select("scan_id", "a.*")
        inputs = replace(inputs, scanner_reports=reports, agent_responses=answers)
        _write(scan_of_digest(digest.drop("report", "answers"), path, inputs, options, keep_findings=False), inputs, out_path, batch_id)

    digest = file_digest(read(DIFFS, diffs_path), options)
    rows = with_late_inputs(digest, read(REPORTS, reports_path), read(ANSWERS, answers_path), watermark, wait)
    return _start(rows, handle, checkpoint)
