"""The whole scan as one plan: diffs in, findings and verdicts out.

The raw text is read once.  One narrow pass turns each file section into a small digest
row (rule hits, built-in agent answer, suppressed lines, line numbers); everything after
it works on digests only.  The digest is staged as a table, because several branches read
different columns of it and because a lost executor must not make the pass run again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogue import (
    AGENT_RULES,
    BLOCKED_EXTENSIONS,
    LINE_RULES,
    REGEX_AGENT,
    SUPPRESS_MARKER,
    AgentRule,
    LineRule,
)
from ..functions.strict_json import keep_last_key
from ..functions.text import last_dot_ext
from ..operators import agents, post, rule_scan, scanner
from ..operators.diffs import sections_and_scans, with_added
from ..session import drop_stage, stage


@dataclass(frozen=True)
class ScanOptions:
    """Job options; the defaults scan everything."""

    phase1: bool = True
    phase2: bool = True
    blocked_extensions: Sequence[str] = BLOCKED_EXTENSIONS
    suppress_marker: str = SUPPRESS_MARKER
    line_rules: Sequence[LineRule] = LINE_RULES
    agent_rules: Sequence[AgentRule] = AGENT_RULES


@dataclass
class ScanInputs:
    """Input tables; only the diffs are required, and a stream brings those itself."""

    diffs: DataFrame | None = None
    scanner_reports: DataFrame | None = None
    agent_responses: DataFrame | None = None
    bypassed: DataFrame | None = None
    config_errors: DataFrame | None = None
    ignores: DataFrame | None = None


@dataclass
class ScanResult:
    """Result tables; call ``release`` when all of them have been used."""

    scans: DataFrame
    phase1: DataFrame
    phase2: DataFrame
    findings: DataFrame
    counts: DataFrame
    verdicts: DataFrame
    stage_paths: list[str]

    def release(self) -> None:
        """Delete the staged tables the results read from."""
        for path in self.stage_paths:
            drop_stage(self.scans.sparkSession, path)


def file_digest(diffs: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """One small row per scanned file and one, with ``file_ord`` 0, per scan; a single pass
    over the raw text, no shuffle."""
    sections = sections_and_scans(diffs, options.blocked_extensions)
    files = with_added(sections, options.suppress_marker)
    facts = [c for c in files.columns if c not in ("file_ord", "path", "added")]
    added = F.col("added")
    texts = files.select(
        *facts, "file_ord", "path", "added",
        last_dot_ext(F.col("path")).alias("ext"),
        agents.request_text(added).alias("text"),
    )
    return texts.select(
        *facts, "file_ord", "path",
        (F.col("text") != "").alias("has_request"),
        rule_scan.rule_hits(F.col("ext"), added, options.line_rules).alias("hits"),
        agents.regex_answers(F.col("text"), F.col("path"), options.agent_rules).alias("answer"),
        F.transform(added, lambda x: x["number"]).alias("numbers"),
        F.transform(F.filter(added, lambda x: x["suppressed"]), lambda x: x["number"]).alias(
            "suppressed"
        ),
    )


def run_scan(
    inputs: ScanInputs, options: ScanOptions = ScanOptions(), keep_findings: bool = True
) -> ScanResult:
    """Scan every diff of the input.

    Scans that used a bypass token or whose configuration is broken get their verdict and
    nothing else: no finding of theirs reaches any result table.  ``keep_findings`` stages the
    findings, which counts, verdicts and listings read.
    """
    digest, path = stage(file_digest(inputs.diffs, options), "digest")
    return scan_of_digest(digest, path, inputs, options, keep_findings)


def scan_of_digest(
    digest: DataFrame, path: str, inputs: ScanInputs, options: ScanOptions = ScanOptions(), keep_findings: bool = True
) -> ScanResult:
    """The scan from a staged ``file_digest`` on; ``inputs.diffs`` is not read."""
    # a stream's batches have a session of their own, and the reports are decoded in it
    keep_last_key(digest.sparkSession)
    paths = [path]
    scans = digest.where(F.col("file_ord") == 0).select(
        *[c for c in ("scan_id", "repo", "scan_ts") if c in digest.columns],
        "is_empty", "is_error", "n_files", "n_kept",
    )
    exempt = [t.select("scan_id") for t in (inputs.bypassed, inputs.config_errors) if t is not None]

    def scanned(table: DataFrame) -> DataFrame:
        for ids in exempt:
            table = table.join(ids, "scan_id", "left_anti")
        return table

    # Anti-joined as small rows: the raw text of an exempt diff is never shuffled.
    digest = scanned(digest)

    phase1 = rule_scan.findings_of_hits(digest, options.line_rules)
    if inputs.scanner_reports is not None:
        parsed = scanner.scanner_report(scanned(inputs.scanner_reports))
        remapped = scanner.scanner_remap(
            scanner.report_results(parsed), scanner.scanned_files(digest)
        )
        phase1 = scanner.phase1_source(phase1, remapped, parsed)
    if not options.phase1:
        phase1 = phase1.limit(0)

    builtin = digest.where("has_request").select(
        "scan_id", "file_ord",
        F.col("path").alias("file_path"),
        F.lit(2147483647).alias("agent_ord"),
        F.lit(REGEX_AGENT).alias("agent"),
        F.lit(True).alias("available"),
        F.lit("").alias("error"),
        F.col("answer").alias("findings"),
        F.lit(0).cast("bigint").alias("latency_ms"),
    )
    if inputs.agent_responses is not None:
        winners = agents.resolve_chain(
            agents.attempts(agents.parse_responses(scanned(inputs.agent_responses)), builtin)
        )
        phase2 = agents.agent_findings(agents.phase2_cutoff(winners))
    else:
        phase2 = agents.agent_findings(builtin.withColumnRenamed("agent", "agent_used"))
    if not options.phase2:
        phase2 = phase2.limit(0)

    suppressed = digest.select(
        "scan_id", "path", F.explode("suppressed").alias("line")
    ).distinct()
    found = post.filter_suppressed(post.union_findings(phase1, phase2), suppressed)
    if inputs.ignores is not None:
        found, path = stage(found, "found")
        paths.append(path)
        found = post.ignore_rules(found, inputs.ignores)
    findings = post.dedup_findings(found)
    if keep_findings:
        findings, path = stage(findings, "findings")
        paths.append(path)
    counts = post.severity_counts(findings)
    verdicts = post.scan_verdict(scans, counts, inputs.bypassed, inputs.config_errors)
    return ScanResult(scans, phase1, phase2, findings, counts, verdicts, paths)
