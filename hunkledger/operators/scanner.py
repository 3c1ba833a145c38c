"""Reports of an external scanner: parse, map lines back, choose the Phase 1 source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strict_json as J
from ..functions.arrays import held
from ..functions.findings import as_findings
from ..functions.text import base_name, path_ext, severity_rank, trim_space


def _result_ok(r: Column) -> Column:
    ok = J.is_object(r) & J.is_text(r, "$.check_id") & J.is_text(r, "$.path")
    for place in ("start", "end"):
        ok = ok & J.is_object(r, f"$.{place}")
        ok = ok & J.is_int(r, f"$.{place}.line") & J.is_int(r, f"$.{place}.col")
    ok = ok & J.is_object(r, "$.extra")
    for name in ("message", "severity", "lines"):
        ok = ok & J.is_text(r, f"$.extra.{name}")
    return ok


def _result(r: Column) -> Column:
    return F.struct(
        J.text_at(r, "$.check_id").alias("check_id"),
        J.text_at(r, "$.path").alias("path"),
        J.long_at(r, "$.start.line").alias("start_line"),
        J.long_at(r, "$.start.col").alias("start_col"),
        J.long_at(r, "$.end.line").alias("end_line"),
        J.long_at(r, "$.end.col").alias("end_col"),
        J.text_at(r, "$.extra.message").alias("message"),
        J.text_at(r, "$.extra.severity").alias("severity"),
        J.text_at(r, "$.extra.lines").alias("lines"),
    )


def scanner_report(reports: DataFrame) -> DataFrame:
    """Per scan: status (``ok``, ``scanner_error``, ``unavailable``) and its results.

    Exit codes 0 and 1 carry a report; an empty report is one without results.  Of a
    repeated key the last value counts.
    """
    J.keep_last_key(reports.sparkSession)
    doc = F.col("_doc")
    parsed = reports.select("*", held(J.strict_variant(F.col("report"))).alias("_doc"))
    readable = (F.col("report") == "") | (
        doc.isNotNull()
        & J.is_object(doc)
        & J.is_array(doc, "$.results")
        & J.is_array(doc, "$.errors")
        & F.forall(J.items_at(doc, "$.results"), _result_ok)
    )
    status = (
        F.when(~F.col("available"), F.lit("unavailable"))
        .when(F.col("exit_code").isin(0, 1) & readable, F.lit("ok"))
        .otherwise(F.lit("scanner_error"))
    )
    rated = parsed.select("scan_id", status.alias("status"), "_doc")
    items = F.when(F.col("status") == "ok", J.items_at(F.col("_doc"), "$.results")).otherwise(
        F.array().cast("array<variant>")
    )
    return rated.select("scan_id", "status", F.transform(items, _result).alias("results"))


def report_results(parsed: DataFrame) -> DataFrame:
    """One row per scanner result, with its position in the report."""
    rows = parsed.select("scan_id", F.posexplode_outer("results").alias("_pos", "_r"))
    return rows.where(F.col("_r").isNotNull()).select(
        "scan_id", (F.col("_pos") + 1).alias("result_ord"), "_r.*"
    )


def flat_name(path: Column) -> Column:
    """Name under which a file was handed to the scanner."""
    flat = F.replace(path, F.lit("/"), F.lit("_"))
    ext = path_ext(path)
    wanted = F.when(ext == "", F.lit(".txt")).otherwise(ext)
    return F.when(path_ext(flat) == wanted, flat).otherwise(F.concat(flat, wanted))


def scanned_files(files: DataFrame) -> DataFrame:
    """Per scan and flat name: the path and the line numbers of its added lines.

    ``files`` holds file rows with either ``added`` lines or their ``numbers``.  Two paths
    with one flat name: the later file wins.  The rows carry numbers only, so this is one
    small aggregate per file, not per line.
    """
    numbers = (
        F.col("numbers")
        if "numbers" in files.columns
        else F.transform("added", lambda x: x["number"])
    )
    return (
        files.select(
            "scan_id", flat_name(F.col("path")).alias("flat"), "file_ord", "path",
            numbers.alias("numbers"),
        )
        .where(F.size("numbers") > 0)
        .groupBy("scan_id", "flat")
        .agg(F.max_by(F.struct("path", "numbers"), "file_ord").alias("_file"))
        .select("scan_id", "flat", "_file.path", "_file.numbers")
    )


def scanner_line_map(files: DataFrame) -> DataFrame:
    """n-th line handed to the scanner ↔ original path and line."""
    rows = scanned_files(files).select(
        "scan_id", "flat", "path", F.posexplode("numbers").alias("_pos", "orig_line")
    )
    return rows.select(
        "scan_id", "flat", (F.col("_pos") + 1).cast("bigint").alias("n"), "path", "orig_line"
    )


def scanner_remap(results: DataFrame, scanned: DataFrame) -> DataFrame:
    """Findings at original lines; results for unknown files drop out, lines outside the
    map keep the scanner's own path and line."""
    file = ["scan_id", "flat"]
    named = results.withColumn("flat", base_name(F.col("path"))).withColumnRenamed("path", "_given")
    start = F.col("start_line")
    # Only the lines that results name leave a file's list of numbers.
    wanted = named.groupBy(*file).agg(F.collect_set("start_line").alias("_wanted"))
    lines = scanned.join(wanted, file).select(
        *file, "path", "numbers", F.explode("_wanted").alias("start_line")
    ).select(
        *file, "path", "start_line",
        F.when(
            (start >= 1) & (start <= F.size("numbers")),
            F.get("numbers", F.when(start.between(1, F.size("numbers")), start - 1).cast("int")),
        ).alias("_line"),
    )
    joined = named.join(lines, [*file, "start_line"])
    inside = F.col("_line").isNotNull()
    return as_findings(
        joined,
        phase=F.lit(1),
        file_ord=F.lit(0),
        line_ord=F.col("result_ord"),
        rule_id=F.col("check_id"),
        path=F.when(inside, F.col("path")).otherwise(F.col("_given")),
        line=F.coalesce("_line", start),
        column=F.col("start_col"),
        end_column=F.col("end_col"),
        severity=severity_rank(F.col("severity")),
        content=trim_space(F.col("lines")),
        source=F.lit("semgrep"),
    )


def phase1_source(
    rule_findings: DataFrame, scanner_findings: DataFrame, status: DataFrame, enabled: bool = True
) -> DataFrame:
    """Scanner findings where the scanner ran well, rule findings elsewhere."""
    if not enabled:
        return rule_findings.limit(0)
    ok = status.where(F.col("status") == "ok").select("scan_id")
    return rule_findings.join(ok, "scan_id", "left_anti").unionByName(
        scanner_findings.join(ok, "scan_id", "left_semi")
    )
