"""Phase 1: match the line rules against added lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import LINE_RULES, LineRule
from ..functions.findings import as_findings
from ..functions.arrays import let, literal_array
from ..functions.prefilter import matches
from ..functions.text import SEVERITIES, last_dot_ext, trim_space


def _matches(rule: LineRule, ext: Column, content: Column, lowered: Column) -> Column:
    hit = matches(rule.pattern, content, lowered, rule.needs)
    # The extension test is cheap and comes first; AND stops there for most files.
    return ext.isin(*rule.file_exts) & hit if rule.file_exts else hit


def rule_hits(ext: Column, added: Column, rules: Sequence[LineRule] = LINE_RULES) -> Column:
    """Hits among the added lines of one file, in order, as ``array<struct<line,rule>>``.

    The catalogue becomes one pass of literal patterns over the lines: no join, no
    shuffle, and each pattern is compiled once per task.
    """

    def of_line(line: Column) -> Column:
        def numbers(lowered: Column) -> Column:
            return F.array_compact(
                F.array(
                    *[
                        F.when(_matches(rule, ext, line["content"], lowered), F.lit(i))
                        for i, rule in enumerate(rules)
                    ]
                )
            )

        return F.transform(
            let(F.lower(line["content"]), numbers),
            lambda rule: F.struct(line.alias("line"), rule.alias("rule")),
        )

    return F.flatten(F.transform(added, of_line))


def findings_of_hits(hits: DataFrame, rules: Sequence[LineRule] = LINE_RULES) -> DataFrame:
    """Findings from file rows with their hits nested in ``hits``."""
    # The outer form keeps Catalyst from inferring a filter that scans the lines again.
    rows = (
        hits.select("scan_id", "file_ord", "path", F.explode_outer("hits").alias("_hit"))
        .where(F.col("_hit").isNotNull())
        .select("scan_id", "file_ord", "path", "_hit.line.*", "_hit.rule")
    )

    def rule_value(values) -> Column:
        return F.get(literal_array(values), F.col("rule"))

    return as_findings(
        rows,
        phase=F.lit(1),
        rule_ord=F.col("rule") + 1,
        rule_id=rule_value([r.rule_id for r in rules]),
        line=F.col("number"),
        message=rule_value([r.message for r in rules]),
        severity=rule_value([SEVERITIES.index(r.severity) for r in rules]),
        content=trim_space(F.col("content")),
        source=F.lit("fallback"),
    )


def rule_scan(files: DataFrame, rules: Sequence[LineRule] = LINE_RULES) -> DataFrame:
    """Every rule on every added line, all matches kept."""
    ext = last_dot_ext(F.col("path"))
    hits = files.withColumn("_ext", ext).select(
        "scan_id", "file_ord", "path", rule_hits(F.col("_ext"), F.col("added"), rules).alias("hits")
    )
    return findings_of_hits(hits, rules)
