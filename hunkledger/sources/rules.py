"""The rule catalogues as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..catalogue import AGENT_RULES, LINE_RULES, RULES_VERSION, AgentRule, LineRule
from ..functions.prefilter import plain_part

_SCHEMA = (
    "version string, rule_set string, rule_ord int, rule_id string, pattern string, "
    "message string, severity string, file_exts array<string>, cwe string, confidence double"
)
_LINE_RULE_SCHEMA = (
    "rule_ord int, rule_id string, pattern string, message string, severity string, "
    "file_exts array<string>, needs array<string>"
)


def rule_catalogue(
    spark: SparkSession,
    line_rules: Sequence[LineRule] = LINE_RULES,
    agent_rules: Sequence[AgentRule] = AGENT_RULES,
) -> DataFrame:
    """Both rule sets, one row per rule; ``file_exts`` NULL means every file."""
    rows = [
        (
            RULES_VERSION, "line", i, r.rule_id, r.pattern, r.message, r.severity,
            list(r.file_exts) or None, "", 0.0,
        )
        for i, r in enumerate(line_rules, 1)
    ] + [
        (
            RULES_VERSION, "agent", i, r.vuln_class, r.pattern, r.description, r.severity,
            None, r.cwe, r.confidence,
        )
        for i, r in enumerate(agent_rules, 1)
    ]
    return spark.createDataFrame(rows, _SCHEMA)


def line_rule_table(spark: SparkSession, line_rules: Sequence[LineRule] = LINE_RULES) -> DataFrame:
    """The line rules as the table that ``indexed_rule_scan`` reads."""
    rows = [
        (i, r.rule_id, r.pattern, r.message, r.severity, list(r.file_exts), [plain_part(n) for n in r.needs])
        for i, r in enumerate(line_rules, 1)
    ]
    return spark.createDataFrame(rows, _LINE_RULE_SCHEMA)
