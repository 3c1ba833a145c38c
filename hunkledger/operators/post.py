"""Post-processing and gate: suppress, dedup, count, decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import glob_pattern
from ..functions.text import SEVERITIES, severity_name
from ..schemas import FINDING_ORDER

IGNORE_SALTS = 32


def suppressed_lines(files: DataFrame) -> DataFrame:
    """(path, line) pairs of added lines with the marker, and of the hunk line right
    after each if that line is added too; marked while parsing (``diffs.with_added``)."""
    marked = F.filter("added", lambda x: x["suppressed"])
    return files.select(
        "scan_id", "path", F.explode(F.transform(marked, lambda x: x["number"])).alias("line")
    ).distinct()


def filter_suppressed(findings: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Findings whose (path, line) is not suppressed in the same scan."""
    return findings.join(suppressed, ["scan_id", "path", "line"], "left_anti").select(
        *findings.columns
    )


def union_findings(phase1: DataFrame, phase2: DataFrame) -> DataFrame:
    """Phase 1 findings, then Phase 2 findings; the order is in the ordinals."""
    return phase1.unionByName(phase2)


def dedup_findings(findings: DataFrame) -> DataFrame:
    """The first finding per ``rule:content`` text in each scan.

    An aggregate, not a window: a finding repeated over a third of all rows shrinks to
    one row per task before the shuffle.
    """
    rest = [c for c in findings.columns if c != "scan_id"]
    key = F.concat_ws(":", "rule_id", "content").alias("_key")
    order = [c for c in FINDING_ORDER if c in rest]
    ordered = F.struct(*order, *[c for c in rest if c not in order])
    return (
        findings.groupBy("scan_id", key)
        .agg(F.min(ordered).alias("_first"))
        .select("scan_id", "_first.*")
        .select(*findings.columns)
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings per severity per scan."""
    counts = [
        F.count_if(F.col("severity") == rank).alias(f"n_{name.lower()}")
        for rank, name in enumerate(SEVERITIES)
    ]
    return findings.groupBy("scan_id").agg(*counts, F.count(F.lit(1)).alias("n_findings"))


def scan_verdict(
    scans: DataFrame,
    counts: DataFrame,
    bypassed: DataFrame | None = None,
    config_errors: DataFrame | None = None,
) -> DataFrame:
    """Status and exit code per scan.

    ``scans``: scan_id, is_empty, is_error, n_files, n_kept (see ``plans.scan``).
    The tests run in this order: config error, bypass, unreadable diff, no files, all
    files filtered, no findings, blocking findings.
    """
    none = scans.select("scan_id").limit(0)
    by = (bypassed if bypassed is not None else none).select("scan_id").distinct()
    bad = (config_errors if config_errors is not None else none).select("scan_id").distinct()
    joined = (
        scans.join(counts, "scan_id", "left")
        .join(by.withColumn("_by", F.lit(True)), "scan_id", "left")
        .join(bad.withColumn("_bad", F.lit(True)), "scan_id", "left")
    )

    def n(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0).cast("bigint"))

    blocking = n("n_error") + n("n_critical")
    status = (
        F.when(F.col("_bad"), F.lit("config_error"))
        .when(F.col("_by"), F.lit("bypassed"))
        .when(F.col("is_error"), F.lit("error"))
        .when(F.col("is_empty") | (F.col("n_files") == 0), F.lit("empty"))
        .when(F.col("n_kept") == 0, F.lit("all_filtered"))
        .when(n("n_findings") == 0, F.lit("clean"))
        .when(blocking > 0, F.lit("blocked"))
        .otherwise(F.lit("passed_with_findings"))
    )
    scanned = status.isin("clean", "blocked", "passed_with_findings")
    return joined.select(
        "scan_id",
        status.alias("status"),
        F.when(status.isin("config_error", "error", "blocked"), 1).otherwise(0).alias("exit_code"),
        F.when(scanned, n("n_findings")).otherwise(0).alias("n_findings"),
        F.when(scanned, blocking).otherwise(0).alias("n_blocking"),
    )


def scan_listing(findings: DataFrame, counts: DataFrame) -> DataFrame:
    """Printable lines per scan: one per finding, then one summary line.

    Lines stay rows with their order columns, so no scan is collected into one value.
    """
    lines = findings.select(
        "scan_id",
        *FINDING_ORDER,
        F.concat(
            F.lit("["), severity_name(F.col("severity")), F.lit("] "), F.col("path"), F.lit(":"),
            F.col("line").cast("string"), F.lit(" — "), F.col("rule_id"), F.lit(" — "),
            F.col("message"),
        ).alias("text"),
    )

    def part(name: str) -> Column:
        c = F.col(f"n_{name}")
        return F.when(c > 0, F.concat(c.cast("string"), F.lit(f" {name}")))

    summary = counts.select(
        "scan_id",
        F.lit(9).alias("phase"),
        *[F.lit(0).alias(c) for c in FINDING_ORDER[1:]],
        F.concat_ws(
            " · ",
            F.concat(F.col("n_findings").cast("string"), F.lit(" finding(s)")),
            part("critical"),
            part("error"),
            part("warning"),
        ).alias("text"),
    )
    return lines.unionByName(summary)


def _glob_key(glob: Column) -> tuple[Column, Column]:
    """What any path that a glob matches begins with, up to its last ``/`` before the first wildcard, and
    the file name it must have; empty texts where the glob says nothing."""
    folder = F.regexp_extract(glob, r"(?s)\A([^*?\x00]*/)", 1)
    return folder, F.regexp_extract(glob, r"(?s)(?:\A|/)([^/*?\x00]*)\z", 1)


def ignored_paths(paths: DataFrame, ignores: DataFrame, salts: int = IGNORE_SALTS) -> DataFrame:
    """The (rule_id, path) rows that a (rule_id, file_glob) pair matches, once each.

    A glob is found by its literal parts, its folder and its file name, and only then tried as a pattern, so a rule may have very many
    globs.  A path is looked up once for each combination of folder depth and name that the globs of its rule have, not
    for every folder above it.  A rule's paths are dealt to ``salts`` keys, each with its copy of the rule's globs.
    """
    folder, name = _glob_key(F.col("file_glob"))
    globs = (
        ignores.where(F.col("rule_id").isNotNull() & F.col("file_glob").isNotNull())
        .select(F.col("rule_id").alias("_rule"), "file_glob").distinct()
        .select(
            "_rule", glob_pattern(F.col("file_glob")).alias("_pattern"), folder.alias("_folder"), name.alias("_name"),
            F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
        )
    )
    depth = F.size(F.split("_folder", "/")) - 1
    shapes = globs.select("_rule", "_salt", depth.alias("_depth"), (F.col("_name") != "").alias("_named")).distinct()
    pairs = paths.select(
        "rule_id", "path", F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int").alias("_at")
    ).distinct()
    of_rule = (F.col("rule_id") == F.col("_rule")) & (F.col("_at") == F.col("_salt"))
    deep_enough = F.size(F.split("path", "/")) > F.col("_depth")
    above = F.when(F.col("_depth") > 0, F.concat(F.expr("substring_index(path, '/', _depth)"), F.lit("/"))).otherwise(F.lit(""))
    keys = pairs.join(shapes, of_rule).where(deep_enough).select(
        "rule_id", "path", "_at", above.alias("_above"),
        F.when(F.col("_named"), F.substring_index("path", "/", -1)).otherwise(F.lit("")).alias("_file"),
    )
    found = (
        of_rule & (F.col("_above") == F.col("_folder")) & (F.col("_file") == F.col("_name"))
        & F.rlike(F.col("path"), F.col("_pattern"))
    )
    return keys.join(globs, found, "left_semi").select("rule_id", "path").distinct()


def ignore_rules(findings: DataFrame, ignores: DataFrame, salts: int = IGNORE_SALTS) -> DataFrame:
    """Drop findings that match a (rule_id, file_glob) pair.

    The findings are read twice, once for their paths: stage them if they are costly.  Those of one rule and
    path are dealt to ``salts`` keys, each with its copy of the ignored path.
    """
    ignored = ignored_paths(findings, ignores, salts).select(
        F.col("rule_id").alias("_rule"), F.col("path").alias("_path"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
    )
    salt = F.pmod(F.xxhash64(findings["scan_id"]), F.lit(salts)).cast("int")
    # by table, as the findings may have columns of these names
    cond = (
        (findings["rule_id"] == ignored["_rule"]) & (findings["path"] == ignored["_path"]) & (salt == ignored["_salt"])
    )
    return findings.join(ignored, cond, "left_anti")
