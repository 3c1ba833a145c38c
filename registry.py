"""The registered queries: each runs one operator over data derived from whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import corpus
from hunkledger.operators import diffs as D
from hunkledger.operators import agents, bypass, context, filters, large_diffs, patches, post, report, rule_scan, scanner
from hunkledger.operators.rule_table import indexed_rule_scan
from hunkledger.plans.partials import refresh_partials, report_from_partials
from hunkledger.plans.report import periodic_report
from hunkledger.plans.scan import ScanInputs, ScanResult, run_scan
from hunkledger.session import stage, work_path
from hunkledger.sources.audit import log_day, log_lines, read_audit, read_plain_audit, write_audit
from hunkledger.sources.diffs import read_diffs
from hunkledger.sources.findings import write_findings
from hunkledger.sources.rules import line_rule_table
from hunkledger.sources.rules import rule_catalogue as catalogue_table
from hunkledger.streaming import audit as audit_streams
from hunkledger.streaming.audit import audit_stream
from hunkledger.streaming.bypass import bypass_stream
from hunkledger.streaming.scan import late_scan_stream, scan_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def text_time(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


_WRITTEN: dict[tuple[str, str, str], str] = {}


def derived(spark: SparkSession, sf_dir: str, name: str, build: Query) -> DataFrame:
    """An input table derived from the given ones, written once per session to the shared
    folder, so that queries start from stored tables as they would in production."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = work_path(spark, name)
        build(spark, sf_dir).write.option("compression", "zstd").parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def diffs_of(spark, sf_dir):
    return derived(spark, sf_dir, "diffs", corpus.diffs)


PIECE_BITS = 3


def kept_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.with_added(filters.filter_blocked(D.file_sections(diffs_of(spark, sf_dir))))


SHORT = (
    "scan_id", "phase", "file_ord", "hunk_ord", "line_ord", "rule_ord", "rule_id", "path", "line",
    "message", "severity", "content", "source",
)


@query
def read_diffs_(spark, sf_dir):
    path = work_path(spark, "diffs")
    corpus.diffs(spark, sf_dir).write.parquet(path)
    return read_diffs(spark, path).select(
        "scan_id", "repo", text_time("scan_ts"), "is_empty", F.length("raw").alias("n_chars"),
        F.md5("raw").alias("raw_md5"),
    )


QUERIES["read_diffs"] = QUERIES.pop("read_diffs_")


@query
def diff_files(spark, sf_dir):
    return D.diff_files(diffs_of(spark, sf_dir))


@query
def diff_hunks(spark, sf_dir):
    return D.diff_hunks(diffs_of(spark, sf_dir))


@query
def diff_lines(spark, sf_dir):
    return D.diff_lines(diffs_of(spark, sf_dir))


@query
def diff_errors(spark, sf_dir):
    return D.diff_errors(diffs_of(spark, sf_dir))


def cut_of(spark, sf_dir):
    return large_diffs.cut_diffs(large_diffs.split_lines(diffs_of(spark, sf_dir)), piece_bits=PIECE_BITS)


@query
def large_diff_files(spark, sf_dir):
    """The same diffs as lines, in pieces so small that most diffs are cut."""
    return large_diffs.large_diff_files(cut_of(spark, sf_dir))


@query
def large_diff_hunks(spark, sf_dir):
    return large_diffs.large_diff_hunks(cut_of(spark, sf_dir))


@query
def large_diff_lines(spark, sf_dir):
    return large_diffs.large_diff_lines(cut_of(spark, sf_dir))


@query
def large_diff_errors(spark, sf_dir):
    return large_diffs.large_diff_errors(cut_of(spark, sf_dir))


@query
def filter_blocked(spark, sf_dir):
    return filters.filter_blocked(D.diff_files(diffs_of(spark, sf_dir)))


@query
def added_lines(spark, sf_dir):
    return filters.added_lines(kept_files(spark, sf_dir))


@query
def rule_scan_(spark, sf_dir):
    return rule_scan.rule_scan(kept_files(spark, sf_dir)).select(*SHORT)


QUERIES["rule_scan"] = QUERIES.pop("rule_scan_")


@query
def rule_scan_indexed(spark, sf_dir):
    """The rules as a table, looked up by the texts they need."""
    return indexed_rule_scan(kept_files(spark, sf_dir), line_rule_table(spark)).select(*SHORT)


@query
def suppressed_lines(spark, sf_dir):
    return post.suppressed_lines(kept_files(spark, sf_dir))


# --- Whole scans --------------------------------------------------------------------


def requests_of(spark, sf_dir):
    return agents.agent_requests(kept_files(spark, sf_dir))


def build_line_counts(spark, sf_dir):
    lines = F.size(F.split("added_lines", "\n"))
    made = agents.file_requests(kept_files(spark, sf_dir), F.size("added").alias("n_added"))
    return made.select("scan_id", "file_ord", "path", "n_added", F.when(F.col("added_lines").isNotNull(), lines).alias("added_count"))


def line_counts_of(spark, sf_dir):
    """Files with their numbers of lines, for the recorded responses and reports: the diffs are cut once for both."""
    return derived(spark, sf_dir, "line_counts", build_line_counts)


def build_responses(spark, sf_dir):
    chain = agents.default_chain(corpus.repo_config(spark, sf_dir))
    requests = line_counts_of(spark, sf_dir).where(F.col("added_count").isNotNull())
    return corpus.agent_responses(requests.withColumnRenamed("path", "file_path"), chain)


def responses_of(spark, sf_dir):
    return derived(spark, sf_dir, "agent_responses", build_responses)


def reports_of(spark, sf_dir):
    return derived(
        spark, sf_dir, "scanner_reports",
        lambda sp, sf: corpus.scanner_reports(line_counts_of(sp, sf)),
    )


def remote_attempts(spark, sf_dir):
    return agents.parse_responses(responses_of(spark, sf_dir))


def full_winners(spark, sf_dir):
    builtin = agents.regex_agent(requests_of(spark, sf_dir))
    return agents.resolve_chain(agents.attempts(remote_attempts(spark, sf_dir), builtin))


def wire_text(f):
    """A wire finding as one comparable line."""
    return F.concat_ws(
        "|", f["id"], f["severity"], f["vuln_class"], f["description"],
        f["line_number"].cast("string"), f["code_snippet"],
        F.round(f["confidence"] * 100).cast("int").cast("string"), f["cwe"], f["fix"]["fixed_line"],
        f["fix"]["explanation"], f["fix"]["automated"].cast("string"),
    )


def wire_column(name="findings"):
    return F.array_join(F.transform(name, wire_text), "\n").alias("findings")


@query
def agent_requests(spark, sf_dir):
    return requests_of(spark, sf_dir)


@query
def agent_messages(spark, sf_dir):
    return agents.agent_messages(requests_of(spark, sf_dir), "gemini-2.0-flash")


@query
def regex_agent(spark, sf_dir):
    return agents.regex_agent(requests_of(spark, sf_dir)).select(
        "scan_id", "file_ord", "file_path", "agent", wire_column()
    )


@query
def response_status(spark, sf_dir):
    return agents.response_status(responses_of(spark, sf_dir)).select(
        "scan_id", "file_ord", "agent_ord", "provider", "http_status", "status_error"
    )


@query
def parse_responses(spark, sf_dir):
    return remote_attempts(spark, sf_dir).select(
        "scan_id", "file_ord", "agent_ord", "agent", "available", "error", wire_column(),
        F.size("findings").alias("n_findings"),
    )


@query
def resolve_chain(spark, sf_dir):
    """Recorded attempts only, so that some requests exhaust their chain."""
    return agents.resolve_chain(remote_attempts(spark, sf_dir)).select(
        "scan_id", "file_ord", "exhausted", "agent_used", "latency_ms", wire_column()
    )


@query
def phase2_cutoff(spark, sf_dir):
    winners = agents.resolve_chain(remote_attempts(spark, sf_dir))
    return agents.phase2_cutoff(winners).select("scan_id", "file_ord", "agent_used")


@query
def agent_findings(spark, sf_dir):
    winners = agents.phase2_cutoff(full_winners(spark, sf_dir))
    return agents.agent_findings(winners).select(
        "scan_id", "file_ord", "line_ord", "rule_id", "path", "line", "message", "severity",
        "content", "source", F.round(F.col("confidence") * 100).cast("int").alias("confidence_pct"),
        "llm_id", "vuln_class", "cwe", "auto_fixable", "fixed_line", "fix_explain",
    )


@query
def default_chain(spark, sf_dir):
    return agents.default_chain(corpus.repo_config(spark, sf_dir))


def scanner_inputs(spark, sf_dir):
    files = kept_files(spark, sf_dir)
    return files, scanner.scanner_report(reports_of(spark, sf_dir))


@query
def scanner_report(spark, sf_dir):
    _, parsed = scanner_inputs(spark, sf_dir)
    return parsed.select(
        "scan_id", "status", F.posexplode_outer("results").alias("_pos", "_r")
    ).select(
        "scan_id", "status", (F.col("_pos") + 1).alias("result_ord"), "_r.*"
    )


@query
def scanner_line_map(spark, sf_dir):
    return scanner.scanner_line_map(kept_files(spark, sf_dir))


@query
def scanner_remap(spark, sf_dir):
    files, parsed = scanner_inputs(spark, sf_dir)
    return scanner.scanner_remap(
        scanner.report_results(parsed), scanner.scanned_files(files)
    ).select(*SHORT, "column", "end_line", "end_column")


_RESULTS: dict[tuple[str, str], ScanResult] = {}


def scan_inputs(spark, sf_dir):
    """Everything a scan can take but ignores, which derive from its findings."""
    diffs = diffs_of(spark, sf_dir)
    return ScanInputs(
        diffs=diffs,
        scanner_reports=reports_of(spark, sf_dir),
        agent_responses=responses_of(spark, sf_dir),
        bypassed=derived(spark, sf_dir, "bypassed", scan_bypasses),
        config_errors=corpus.config_errors(diffs),
    )


def scan_result(spark, sf_dir):
    """The whole pipeline over documents; one digest and one table of findings a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RESULTS:
        _RESULTS[key] = run_scan(scan_inputs(spark, sf_dir))
    return _RESULTS[key]


def forget_results() -> None:
    """Delete what ``scan_result`` staged, so that the next query scans again."""
    for result in _RESULTS.values():
        result.release()
    _RESULTS.clear()


def scan_bypasses(spark, sf_dir):
    """Scans of the documents corpus that consume a bypass token."""
    scans = diffs_of(spark, sf_dir).select("scan_id", "repo", "scan_ts")
    tokens = bypass.bypass_tokens(corpus.scan_token_issues(scans))
    return bypass.bypass_match(tokens, scans)


@query
def phase1_source(spark, sf_dir):
    return scan_result(spark, sf_dir).phase1.select(*SHORT)


@query
def union_findings(spark, sf_dir):
    result = scan_result(spark, sf_dir)
    return post.union_findings(result.phase1, result.phase2).select(*SHORT)


@query
def filter_suppressed(spark, sf_dir):
    result = scan_result(spark, sf_dir)
    findings = post.union_findings(result.phase1, result.phase2)
    suppressed = post.suppressed_lines(kept_files(spark, sf_dir))
    return post.filter_suppressed(findings, suppressed).select(*SHORT)


@query
def dedup_findings(spark, sf_dir):
    return scan_result(spark, sf_dir).findings.select(*SHORT)


@query
def severity_counts(spark, sf_dir):
    return scan_result(spark, sf_dir).counts


@query
def scan_verdict(spark, sf_dir):
    return scan_result(spark, sf_dir).verdicts


@query
def scan_listing(spark, sf_dir):
    result = scan_result(spark, sf_dir)
    return post.scan_listing(result.findings, result.counts)


@query
def ignore_rules(spark, sf_dir):
    """Ignore each rule below the source folders named after its length."""
    result = scan_result(spark, sf_dir)
    return post.ignore_rules(result.findings, corpus.ignores(result.findings)).select(*SHORT)


@query
def rule_catalogue(spark, sf_dir):
    """The catalogue with the number of findings of each line rule."""
    hits = rule_scan.rule_scan(kept_files(spark, sf_dir)).groupBy("rule_ord").count()
    rules = catalogue_table(spark)
    counted = hits.withColumn("rule_set", F.lit("line"))
    return rules.join(counted, ["rule_set", "rule_ord"], "left").select(
        "version", "rule_set", "rule_ord", "rule_id", "pattern", "message", "severity",
        F.array_join("file_exts", ",").alias("file_exts"), "cwe",
        F.round(F.col("confidence") * 100).cast("int").alias("confidence_pct"),
        F.coalesce("count", F.lit(0)).alias("n_findings"),
    )


@query
def findings_sink(spark, sf_dir):
    """Findings written as JSON rows and read back as text."""
    path = work_path(spark, "findings")
    write_findings(rule_scan.rule_scan(kept_files(spark, sf_dir)), diffs_of(spark, sf_dir), path)
    written = spark.read.schema("value string, repo string").text(path)
    return written.select("repo", F.col("value").alias("json"))


# --- Audit log and report -----------------------------------------------------------

AS_OF = datetime(2024, 1, 31, tzinfo=timezone.utc)
DAYS = 20
AUDIT_TEXTS = (
    "timestamp", "action", "rule_id", "path", "severity", "source", "message", "reason", "patch_hash",
)


def as_of():
    return F.timestamp_seconds(F.lit(int(AS_OF.timestamp())))


def audit_of(spark, sf_dir):
    return derived(spark, sf_dir, "audit_entries", corpus.audit_entries)


def audit_log_path(spark, sf_dir):
    """Log lines written as text, one folder per repository."""
    key = (spark.sparkContext.applicationId, sf_dir, "audit_log")
    if key not in _WRITTEN:
        path = work_path(spark, "audit_log")
        corpus.audit_lines(audit_of(spark, sf_dir)).write.partitionBy("log_date", "repo").text(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def dated_audit_of(spark, sf_dir):
    """The entries divided by day."""
    key = (spark.sparkContext.applicationId, sf_dir, "dated_audit")
    if key not in _WRITTEN:
        path = work_path(spark, "dated_audit")
        entries = audit_of(spark, sf_dir)
        entries.withColumn("log_date", log_day(F.col("timestamp"))).write.partitionBy("log_date").parquet(path)
        _WRITTEN[key] = path
    schema = audit_of(spark, sf_dir).schema.add("log_date", "string")
    return spark.read.schema(schema).parquet(_WRITTEN[key])


def window_of(spark, sf_dir):
    return report.audit_window(dated_audit_of(spark, sf_dir), as_of(), DAYS)


def counts_of(spark, sf_dir):
    return report.entry_counts(window_of(spark, sf_dir))


def named(key: str):
    """Register a query under a key that is also the name of something imported."""

    def add(fn: Query) -> Query:
        QUERIES[key] = fn
        return fn

    return add


@named("read_audit")
def _(spark, sf_dir):
    return read_audit(spark, audit_log_path(spark, sf_dir))


def plain_logs_path(spark, sf_dir):
    """The log as the command-line tool keeps it: a file for each repository."""
    key = (spark.sparkContext.applicationId, sf_dir, "plain_logs")
    if key not in _WRITTEN:
        path = work_path(spark, "plain_logs")
        corpus.write_plain_logs(audit_of(spark, sf_dir), path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


@named("read_plain_audit")
def _(spark, sf_dir):
    """Entries of plain logs; their numbers only say the order, so they are ranked."""
    entries = read_plain_audit(spark, plain_logs_path(spark, sf_dir))
    place = F.row_number().over(Window.partitionBy("repo").orderBy("log_seq"))
    return entries.withColumn("log_seq", place.cast("bigint"))


@named("plain_report")
def _(spark, sf_dir):
    out = work_path(spark, "plain_reports")
    periodic_report(spark, plain_logs_path(spark, sf_dir), out, AS_OF, plain=True)
    return report_columns(spark.read.parquet(out))


@named("tail_audit")
def _(spark, sf_dir):
    """Plain logs read as a stream, then read on after they have grown."""
    logs, out, checkpoint = (work_path(spark, f"tail_{part}") for part in ("logs", "table", "ckpt"))
    entries = audit_of(spark, sf_dir)
    middle = entries.agg(F.expr("(min(log_seq) + max(log_seq)) div 2")).first()[0] or 0
    for known in (entries.where(F.col("log_seq") <= middle), entries):
        corpus.write_plain_logs(known, logs)
        audit_streams.tail_audit(spark, logs, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@named("write_audit")
def _(spark, sf_dir):
    path = work_path(spark, "written_audit")
    write_audit(audit_of(spark, sf_dir), path, F.lit("2024-02-01T00:00:00Z"))
    return log_lines(spark, path).select("repo", "log_date", F.col("value").alias("json"))


@named("audit_append")
def _(spark, sf_dir):
    """Bypasses, unscanned commits and review outcomes, appended to a log and read back."""
    path = work_path(spark, "appended_audit")
    commits = corpus.commits(spark, sf_dir)
    for rows in (
        bypass.bypass_audit(matches_of(spark, sf_dir)),
        bypass.unscanned_commits(commits, corpus.event_scans(spark, sf_dir)),
        patches.review_audit(outcomes_of(spark, sf_dir), diffs_of(spark, sf_dir)),
    ):
        write_audit(rows, path, F.lit("2024-02-01T00:00:00Z"))
    return read_audit(spark, path)


@query
def audit_window(spark, sf_dir):
    return window_of(spark, sf_dir).select(
        "repo", "log_seq", "timestamp",
        F.date_format(report.parse_rfc3339(F.col("timestamp")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("moment"),
    )


@query
def audit_breakdown(spark, sf_dir):
    return report.audit_breakdown(counts_of(spark, sf_dir))


@query
def top_rules(spark, sf_dir):
    return report.top_rules(counts_of(spark, sf_dir))


@query
def bypass_history(spark, sf_dir):
    return report.bypass_history(counts_of(spark, sf_dir))


@query
def trend(spark, sf_dir):
    return report.trend(window_of(spark, sf_dir))


def report_columns(reports):
    """Maps and lists as JSON text, for comparison."""
    return reports.select(
        "repo", "generated_at", "period_days", "total_events",
        *[F.to_json(c).alias(c) for c in ("severity", "actions", "top_rules", "sources")],
        "bypass_count", "no_verify_count", "trend",
    )


@query
def report_json(spark, sf_dir):
    return report.report_json(report.report(window_of(spark, sf_dir), as_of(), DAYS))


@query
def report_bars(spark, sf_dir):
    return report.report_bars(report.audit_breakdown(counts_of(spark, sf_dir)))


@named("periodic_report")
def _(spark, sf_dir):
    out = work_path(spark, "reports")
    periodic_report(spark, audit_log_path(spark, sf_dir), out, AS_OF)
    return report_columns(spark.read.parquet(out))


@query
def partial_report(spark, sf_dir):
    """From daily partials of a log that arrives in two parts; the second adds to days that the first had counted."""
    log, partials, out = (work_path(spark, name) for name in ("grown_log", "partials", "partial_reports"))
    lines = corpus.audit_lines(audit_of(spark, sf_dir))
    early = (F.col("log_date") < "2024-01-27") & (F.crc32(F.col("value").cast("binary")) % 3 != 0)
    for part in (early, ~early):
        lines.where(part).hint("rebalance", "log_date", "repo").write.mode("append").partitionBy("log_date", "repo").text(log)
        refresh_partials(spark, log, partials)
    report_from_partials(spark, log, partials, out, AS_OF)
    return report_columns(spark.read.parquet(out))


# --- Bypass -------------------------------------------------------------------------


@query
def bypass_tokens(spark, sf_dir):
    return bypass.bypass_tokens(corpus.bypass_issues(spark, sf_dir)).select(
        "repo", "id", "reason", text_time("created_at"), text_time("expires_at")
    )


def matches_of(spark, sf_dir):
    tokens = bypass.bypass_tokens(corpus.bypass_issues(spark, sf_dir))
    return bypass.bypass_match(tokens, corpus.event_scans(spark, sf_dir))


@query
def bypass_match(spark, sf_dir):
    return matches_of(spark, sf_dir).select(
        "scan_id", "repo", "token_id", "reason", text_time("scan_ts"), text_time("created_at")
    )


@query
def bypass_audit(spark, sf_dir):
    return bypass.bypass_audit(matches_of(spark, sf_dir))


@query
def unscanned_commits(spark, sf_dir):
    return bypass.unscanned_commits(
        corpus.commits(spark, sf_dir), corpus.event_scans(spark, sf_dir)
    )


# --- Streams ------------------------------------------------------------------------


@named("audit_stream")
def _(spark, sf_dir):
    out, checkpoint = work_path(spark, "audit_stream"), work_path(spark, "audit_ckpt")
    for running in audit_stream(spark, audit_log_path(spark, sf_dir), out, checkpoint):
        running.awaitTermination()
    both = [
        spark.read.parquet(f"{out}/{kind}").withColumn("kind", F.lit(kind))
        for kind in ("daily", "monthly")
    ]
    return both[0].unionByName(both[1]).select(
        "kind", text_time("start"), text_time("end"), "repo", "severity", "n"
    )


@named("scan_stream")
def _(spark, sf_dir):
    diffs_of(spark, sf_dir)
    source = _WRITTEN[(spark.sparkContext.applicationId, sf_dir, "diffs")]
    out = work_path(spark, "scan_stream")
    others = scan_inputs(spark, sf_dir)
    scan_stream(spark, source, out, work_path(spark, "scan_ckpt"), others=others).awaitTermination()
    return spark.read.parquet(f"{out}/verdicts").drop("batch_id")


@named("late_scan_stream")
def _(spark, sf_dir):
    """Diffs and their answers first, then the reports; one scan in six never gets its report.  A last, empty diff a year later
    lets the watermark pass all of them."""
    diffs = diffs_of(spark, sf_dir)
    at, number = diffs.select("scan_id", "scan_ts"), F.col("scan_id")
    # a month of scans or more arrives at once, so the watermark stays behind all of them
    later = lambda minutes: F.col("scan_ts") + F.make_interval(mins=(number % minutes).cast("int"))
    answer = [c for c in responses_of(spark, sf_dir).columns if c != "scan_id"]
    answers = responses_of(spark, sf_dir).groupBy("scan_id").agg(F.collect_list(F.struct(*answer)).alias("answers"))
    arrivals = (
        {"diffs": diffs.select("scan_id", "repo", "scan_ts", "raw"),
         "answers": answers.join(at, "scan_id").select("scan_id", "answers", later(50).alias("answers_ts"))},
        {"reports": reports_of(spark, sf_dir).where("scan_id % 6 <> 1").join(at, "scan_id").select(
            "scan_id", "available", "exit_code", "report", later(60).alias("report_ts"))},
        {"diffs": at.agg(F.max("scan_ts")).select(
            F.lit(-1).cast("bigint").alias("scan_id"), F.lit("none").alias("repo"), (F.col("max(scan_ts)") + F.expr("INTERVAL 400 DAYS")).alias("scan_ts"), F.lit("").alias("raw"))},
    )
    paths = {name: work_path(spark, f"late_{name}") for name in ("diffs", "reports", "answers", "out", "ckpt")}
    others = replace(scan_inputs(spark, sf_dir), diffs=None, scanner_reports=None, agent_responses=None)
    arrivals[1]["reports"].limit(0).write.parquet(paths["reports"])
    for tables in arrivals:
        for name, rows in tables.items():
            rows.write.mode("append").parquet(paths[name])
        late_scan_stream(spark, *paths.values(), watermark="300 days", wait="1 hour", others=others).awaitTermination()
    return spark.read.parquet(f"{paths['out']}/verdicts").where("scan_id >= 0").drop("batch_id")


@named("bypass_stream")
def _(spark, sf_dir):
    """Issues and scans of the events, arriving in three runs up to a day late; settled matches only."""
    issues, scans, out, checkpoint = (work_path(spark, f"bypass_{part}") for part in ("issues", "scans", "matches", "ckpt"))
    tables = {issues: (corpus.bypass_issues(spark, sf_dir), "created_at"), scans: (corpus.event_scans(spark, sf_dir).drop("commit"), "scan_ts")}
    for cut in ("< 10", "BETWEEN 10 AND 19", "> 19"):
        for path, (rows, at) in tables.items():
            arrival = F.col(at) + F.make_interval(secs=F.pmod(F.xxhash64("repo", at), F.lit(86_400)).cast("decimal(18,6)"))
            arrived = rows.withColumn("day", F.datediff(arrival, F.lit("2024-01-01"))).where(f"day {cut}").drop("day")
            arrived.write.mode("append").parquet(path)
        bypass_stream(spark, issues, scans, out, checkpoint, watermark="1 day").awaitTermination()
    return spark.read.parquet(out).select("scan_id", "repo", "token_id", "reason", text_time("scan_ts"), text_time("created_at"))


# --- Related files ------------------------------------------------------------------


def repo_of(spark, sf_dir):
    return derived(spark, sf_dir, "repo_files", corpus.repo_files)


@query
def import_candidates(spark, sf_dir):
    return context.import_candidates(kept_files(spark, sf_dir), repo_of(spark, sf_dir))


@query
def sibling_candidates(spark, sf_dir):
    return context.sibling_candidates(kept_files(spark, sf_dir), repo_of(spark, sf_dir))


@query
def signatures(spark, sf_dir):
    return context.signatures(repo_of(spark, sf_dir))


@query
def related_files(spark, sf_dir):
    # Three branches read the files: the diffs are cut once.
    files, _ = stage(kept_files(spark, sf_dir), "kept-files")
    repo = repo_of(spark, sf_dir)
    return context.related_files(
        context.import_candidates(files, repo), context.sibling_candidates(files, repo), files, repo
    )


# --- Patches and review -------------------------------------------------------------


def build_review_findings(spark, sf_dir):
    """Every rule finding twice, so that patches of one line compete."""
    found = rule_scan.rule_scan(kept_files(spark, sf_dir))
    # Copied row by row: a union would search the diffs once for each side.
    return patches.rank_findings(found.withColumn("phase", F.explode(F.array(F.lit(1), F.lit(2)))))


def review_of(spark, sf_dir):
    """(findings, patches, decisions, repository files)"""
    found = derived(spark, sf_dir, "review_findings", build_review_findings)
    return found, corpus.patches(found), corpus.decisions(found), repo_of(spark, sf_dir)


@query
def patch_check(spark, sf_dir):
    _, proposed, _, repo = review_of(spark, sf_dir)
    return patches.patch_check(proposed, repo)


@query
def patch_apply(spark, sf_dir):
    _, proposed, chosen, repo = review_of(spark, sf_dir)
    return patches.patch_apply(chosen, proposed, repo)[1]


def outcomes_of(spark, sf_dir):
    found, proposed, chosen, repo = review_of(spark, sf_dir)
    # The points, the order and the outcomes read the accepted patches: they are checked once for all.
    accepted, _ = stage(patches.accepted_patches(chosen, proposed, patches.patch_check(proposed, repo)), "accepted-patches")
    return patches.review_outcomes(found, proposed, patches.apply_order(accepted))


@query
def review_outcomes(spark, sf_dir):
    return outcomes_of(spark, sf_dir)


@query
def review_summary(spark, sf_dir):
    return patches.review_summary(outcomes_of(spark, sf_dir))


def prepare(spark: SparkSession, sf_dir: str) -> None:
    """Write every derived input table, so that later queries only read them."""
    for build in (diffs_of, responses_of, reports_of, repo_of, audit_of, review_of):
        build(spark, sf_dir)
    audit_log_path(spark, sf_dir)
