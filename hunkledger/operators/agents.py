"""Phase 2: requests per file, recorded agent responses, first acceptable answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalogue import (
    AGENT_RULES,
    CONFIDENCE_FLOOR,
    GEMINI_AGENT,
    LOCAL_AGENT_PREFIX,
    OPENROUTER_AGENT,
    REGEX_AGENT,
    SNIPPET_BYTES,
    STATUS_ERRORS,
    STATUS_OTHER,
    SYSTEM_PROMPT,
    TEMPERATURE,
    AgentRule,
)
from ..functions import strict_json as J
from ..functions.arrays import held, let, literal_array
from ..functions.findings import as_findings
from ..functions.prefilter import matches
from ..functions.text import (
    first_bytes,
    path_ext,
    severity_rank,
    short_hash,
    strip_fences,
    trim_space,
)
from ..schemas import WIRE_FINDING

_NO_FINDINGS = f"array<{WIRE_FINDING}>"


def request_text(added: Column) -> Column:
    """The added lines of a file as one trimmed text."""
    return trim_space(F.array_join(F.transform(added, lambda x: x["content"]), "\n"))


def file_requests(files: DataFrame, *more: Column) -> DataFrame:
    """Every file with the request made of its added lines, or with NULL for ``added_lines`` where those are white space."""
    # One-element array: the text is built once, kept if not empty, then reused.
    text = F.filter(F.array(request_text(F.col("added"))), lambda t: t != "")
    return files.select(
        "scan_id", "file_ord", "path", *more, F.explode_outer(text).alias("added_lines")
    )


def agent_requests(files: DataFrame) -> DataFrame:
    """One request per file with anything but white space among its added lines."""
    return file_requests(files).where(F.col("added_lines").isNotNull()).select(
        "scan_id",
        "file_ord",
        F.col("path").alias("file_path"),
        path_ext(F.col("path")).alias("language"),
        "added_lines",
        F.size(F.split("added_lines", "\n")).alias("added_count"),
    )


def _escape_markup(json: Column) -> Column:
    """Write ``<``, ``>``, ``&`` and U+2028, U+2029 as escapes."""
    for code in ("003c", "003e", "0026", "2028", "2029"):
        json = F.replace(json, F.lit(chr(int(code, 16))), F.lit("\\u" + code))
    return json


def agent_messages(requests: DataFrame, model: str, system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """User message and chat request body per request."""
    user = F.concat(
        F.lit("Analyze this diff for security vulnerabilities:\nLanguage: "), F.col("language"),
        F.lit("\nFile: "), F.col("file_path"), F.lit("\n\n```diff\n"), F.col("added_lines"),
        F.lit("\n```\n\nAdded lines: "), F.col("added_count").cast("string"),
    )

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    body = F.struct(
        F.lit(model).alias("model"),
        F.array(message("system", F.lit(system_prompt)), message("user", F.col("user_message"))).alias(
            "messages"
        ),
        F.lit(TEMPERATURE).alias("temperature"),
    )
    return requests.withColumn("user_message", user).select(
        "scan_id", "file_ord", "user_message", _escape_markup(F.to_json(body)).alias("body")
    )


def regex_answers(
    text: Column, file_path: Column, rules: Sequence[AgentRule] = AGENT_RULES
) -> Column:
    """Answer of the built-in agent: per line the first rule that matches."""

    def rule_of(line: Column, lowered: Column) -> Column:
        first = None
        for i, rule in enumerate(rules):
            hit = matches(rule.pattern, line, lowered, rule.needs)
            first = F.when(hit, F.lit(i)) if first is None else first.when(hit, F.lit(i))
        return first

    numbered = F.transform(
        F.split(text, "\n"),
        lambda line, i: F.struct(
            (i + 1).cast("bigint").alias("n"),
            line.alias("line"),
            let(F.lower(line), lambda low: rule_of(line, low)).alias("rule"),
        ),
    )

    def value(x: Column, values) -> Column:
        return F.get(literal_array(values), x["rule"])

    def finding(x: Column) -> Column:
        vuln_class = value(x, [r.vuln_class for r in rules])
        return F.struct(
            short_hash(file_path, x["n"].cast("string"), vuln_class).alias("id"),
            value(x, [r.severity for r in rules]).alias("severity"),
            vuln_class.alias("vuln_class"),
            value(x, [r.description for r in rules]).alias("description"),
            x["n"].alias("line_number"),
            first_bytes(trim_space(x["line"]), SNIPPET_BYTES).alias("code_snippet"),
            value(x, [r.confidence for r in rules]).alias("confidence"),
            value(x, [r.cwe for r in rules]).alias("cwe"),
            F.struct(
                F.lit("").alias("fixed_line"),
                F.concat(
                    value(x, [r.description for r in rules]),
                    F.lit(" — manual remediation required"),
                ).alias("explanation"),
                F.lit(False).alias("automated"),
            ).alias("fix"),
        )

    return F.transform(F.filter(numbered, lambda x: x["rule"].isNotNull()), finding)


def regex_agent(requests: DataFrame, rules: Sequence[AgentRule] = AGENT_RULES) -> DataFrame:
    """Attempts of the built-in agent, one per request; it is always available."""
    return requests.select(
        "scan_id",
        "file_ord",
        "file_path",
        F.lit(REGEX_AGENT).alias("agent"),
        F.lit(True).alias("available"),
        F.lit("").alias("error"),
        regex_answers(F.col("added_lines"), F.col("file_path"), rules).alias("findings"),
        F.lit(0).cast("bigint").alias("latency_ms"),
    )


def status_error(provider: Column, status: Column) -> Column:
    """Error text of a recorded HTTP status; empty for 200."""
    error = F.when(status == 200, F.lit(""))
    for name, code, text in STATUS_ERRORS:
        error = error.when((provider == name) & (status == code), F.lit(text))
    for name, prefix in STATUS_OTHER.items():
        error = error.when(provider == name, F.concat(F.lit(prefix), status.cast("string")))
    return error.otherwise(F.concat(provider, F.lit(": no response")))


def response_status(responses: DataFrame) -> DataFrame:
    """Responses with ``status_error``: empty when the provider answered 200."""
    return responses.withColumn("status_error", status_error(F.col("provider"), F.col("http_status")))


def _well_formed_answer(v: Column) -> Column:
    texts = ("id", "severity", "vuln_class", "description", "code_snippet", "cwe")

    def finding_ok(f: Column) -> Column:
        ok = J.is_object(f) & J.is_int(f, "$.line_number") & J.is_number(f, "$.confidence")
        for name in texts:
            ok = ok & J.is_text(f, f"$.{name}")
        return (
            ok
            & J.is_object(f, "$.fix")
            & J.is_text(f, "$.fix.fixed_line")
            & J.is_text(f, "$.fix.explanation")
            & J.is_bool(f, "$.fix.automated")
        )

    return (
        v.isNotNull()
        & J.is_object(v)
        & J.is_array(v, "$.findings")
        & J.is_text(v, "$.agent_used")
        & J.is_int(v, "$.latency_ms")
        & F.forall(J.items_at(v, "$.findings"), finding_ok)
    )


def _decode_finding(f: Column) -> Column:
    return F.struct(
        J.text_at(f, "$.id").alias("id"),
        J.text_at(f, "$.severity").alias("severity"),
        J.text_at(f, "$.vuln_class").alias("vuln_class"),
        J.text_at(f, "$.description").alias("description"),
        J.long_at(f, "$.line_number").alias("line_number"),
        J.text_at(f, "$.code_snippet").alias("code_snippet"),
        F.coalesce(F.try_variant_get(f, "$.confidence", "double"), F.lit(0.0)).alias("confidence"),
        J.text_at(f, "$.cwe").alias("cwe"),
        F.struct(
            J.text_at(f, "$.fix.fixed_line").alias("fixed_line"),
            J.text_at(f, "$.fix.explanation").alias("explanation"),
            F.coalesce(F.try_variant_get(f, "$.fix.automated", "boolean"), F.lit(False)).alias(
                "automated"
            ),
        ).alias("fix"),
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """Attempts from recorded responses: findings, or the named failure.

    The response itself may carry text after its first JSON value; the answer inside it
    must be exactly one JSON value of the expected types.  Of a repeated key the last value
    counts, in both.
    """
    J.keep_last_key(responses.sparkSession)
    keep = [c for c in responses.columns if c not in ("body", "status_error")]
    outer = response_status(responses).select("*", held(F.try_parse_json("body")).alias("_outer"))
    choice_ok = lambda c: (
        J.is_object(c) & J.is_object(c, "$.message") & J.is_text(c, "$.message.content")
    )
    choices = J.items_at(F.col("_outer"), "$.choices")
    decoded = outer.select(
        *keep,
        "status_error",
        (
            F.col("_outer").isNotNull()
            & J.is_object(F.col("_outer"))
            & J.is_array(F.col("_outer"), "$.choices")
            & F.forall(choices, choice_ok)
        ).alias("_decoded"),
        choices.alias("_choices"),
    )
    content = J.text_at(F.get("_choices", F.lit(0)), "$.message.content")
    answered = decoded.select("*", held(J.strict_variant(strip_fences(content))).alias("_answer"))
    error = (
        F.when(F.col("status_error") != "", F.col("status_error"))
        .when(~F.col("_decoded"), F.lit("decode response"))
        .when(F.size("_choices") == 0, F.lit("response contained no choices"))
        .when(~_well_formed_answer(F.col("_answer")), F.lit("unmarshal findings"))
        .otherwise(F.lit(""))
    )
    findings = F.transform(J.items_at(F.col("_answer"), "$.findings"), _decode_finding)
    return (
        answered.withColumn("error", error)
        .withColumn(
            "findings", F.when(F.col("error") == "", findings).otherwise(F.array().cast(_NO_FINDINGS))
        )
        .select(*keep, "error", "findings")
    )


def max_confidence(findings: Column) -> Column:
    top = F.array_max(F.transform(findings, lambda f: f["confidence"]))
    return F.greatest(F.coalesce(top, F.lit(0.0)), F.lit(0.0))


def resolve_chain(attempts: DataFrame, floor: float = CONFIDENCE_FLOOR) -> DataFrame:
    """Winner per request: the first clean or confident answer, else the last agent's.

    Two ordered aggregates per request and no window: the first attempt acceptable on
    its own, and the last agent by position with whether it answered at all.
    """
    findings = F.coalesce(F.col("findings"), F.array().cast(_NO_FINDINGS))
    rated = attempts.select(
        "scan_id",
        "file_ord",
        "agent_ord",
        (F.col("available") & (F.col("error") == "")).alias("answered"),
        F.struct("file_path", "agent", "latency_ms", findings.alias("findings")).alias("answer"),
    )
    found = F.col("answer.findings")
    good = F.col("answered") & ((F.size(found) == 0) | (max_confidence(found) >= floor))
    picked = rated.groupBy("scan_id", "file_ord").agg(
        F.min_by("answer", F.when(good, F.col("agent_ord"))).alias("first_good"),
        F.max_by(F.when(F.col("answered"), F.col("answer")), F.col("agent_ord")).alias("last"),
    )
    winner = picked.select(
        "scan_id", "file_ord", F.coalesce("first_good", "last").alias("winner")
    )
    return winner.select(
        "scan_id",
        "file_ord",
        F.col("winner").isNull().alias("exhausted"),
        F.col("winner.file_path").alias("file_path"),
        F.col("winner.agent").alias("agent_used"),
        F.col("winner.latency_ms").alias("latency_ms"),
        F.col("winner.findings").alias("findings"),
    )


def phase2_cutoff(winners: DataFrame) -> DataFrame:
    """Winners before the first exhausted request of their scan."""
    # A scan is one diff, so its requests fit a window; the answers are decoded once.
    of_scan = Window.partitionBy("scan_id")
    cut = F.min(F.when(F.col("exhausted"), F.col("file_ord"))).over(of_scan)
    return (
        winners.withColumn("_cut", cut)
        .where(F.col("_cut").isNull() | (F.col("file_ord") < F.col("_cut")))
        .drop("_cut")
    )


def agent_findings(winners: DataFrame) -> DataFrame:
    """Findings of the winning answers in the common shape.

    Only a fix that is automated, not blank and not from the built-in agent is kept.
    """
    rows = winners.select(
        "scan_id", "file_ord", "file_path", "agent_used",
        F.posexplode_outer("findings").alias("_pos", "_f"),
    ).where(F.col("_f").isNotNull())
    fixable = (
        F.col("_f.fix.automated")
        & (trim_space(F.col("_f.fix.fixed_line")) != "")
        & (F.col("agent_used") != REGEX_AGENT)
    )
    return as_findings(
        rows,
        phase=F.lit(2),
        line_ord=F.col("_pos") + 1,
        rule_id=F.col("_f.vuln_class"),
        path=F.col("file_path"),
        line=F.col("_f.line_number"),
        message=F.col("_f.description"),
        severity=severity_rank(F.col("_f.severity")),
        content=F.col("_f.code_snippet"),
        source=F.col("agent_used"),
        confidence=F.col("_f.confidence"),
        llm_id=F.col("_f.id"),
        vuln_class=F.col("_f.vuln_class"),
        cwe=F.col("_f.cwe"),
        auto_fixable=fixable,
        fixed_line=F.when(fixable, F.col("_f.fix.fixed_line")).otherwise(F.lit("")),
        fix_explain=F.when(fixable, F.col("_f.fix.explanation")).otherwise(F.lit("")),
    )


def default_chain(repo_config: DataFrame) -> DataFrame:
    """Agents of each repository in calling order; the built-in agent is always last."""

    def agent(name: Column, provider: str) -> Column:
        return F.struct(name.alias("agent"), F.lit(provider).alias("provider"))

    local = F.coalesce("local_model", F.lit(""))
    chain = F.array_compact(
        F.array(
            F.when(F.col("has_gemini"), agent(F.lit(GEMINI_AGENT), "gemini")),
            F.when(F.col("has_openrouter"), agent(F.lit(OPENROUTER_AGENT), "openrouter")),
            F.when(local != "", agent(F.concat(F.lit(LOCAL_AGENT_PREFIX), local), "ollama")),
            agent(F.lit(REGEX_AGENT), "builtin"),
        )
    )
    return repo_config.select("repo", F.posexplode(chain).alias("_pos", "_a")).select(
        "repo", (F.col("_pos") + 1).alias("agent_ord"), "_a.agent", "_a.provider"
    )


def attempts(parsed: DataFrame, builtin: DataFrame) -> DataFrame:
    """Recorded attempts plus the built-in agent's, which stands after all of them.

    The built-in agent's position is the largest possible one instead of a per-request
    count, so no join or window is needed to place it.
    """
    columns = [
        "scan_id", "file_ord", "file_path", "agent_ord", "agent", "available", "error", "findings",
        "latency_ms",
    ]
    last = builtin.withColumn("agent_ord", F.lit(2147483647))
    return parsed.select(*columns).unionByName(last.select(*columns))
