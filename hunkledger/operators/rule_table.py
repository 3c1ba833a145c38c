"""Phase 1 with rules from a table: any number of rules, one plan.

``rule_scan`` turns each rule into a branch of the generated code, which is right for a catalogue
of dozens.  Here the rules stay rows.  A rule names texts of which every match holds one
(``needs``); a piece of each such text is its key.  Lines are looked up by the pieces they
hold among the texts of all rules, then the text itself is looked for; only the texts a line does
hold meet the rules, and only then is the pattern tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.findings import as_findings
from ..functions.regex import java_pattern
from ..functions.text import SEVERITIES, last_dot_ext, trim_space
from ..session import stage

#: Characters of a key.
GRAM = 3
#: Rules without a usable text meet every line; their keys are dealt to so many parts.
OPEN_PARTS = 64

_LINE = ("scan_id", "file_ord", "path", "hunk_ord", "line_ord")


def _open_key(part: Column) -> Column:
    # shorter or longer than any piece of a line
    return F.concat(F.lit("every:"), part.cast("string"))


def rule_index(rules: DataFrame) -> DataFrame:
    """One row per rule and text it needs, under the key that lines are looked up by.

    ``rules``: rule_ord, rule_id, pattern (RE2 dialect), message, severity (its name), file_exts and
    needs (arrays; NULL or empty: every file, every line).  A rule one of whose texts is shorter than
    a key, or not plain ASCII (lower-casing may change its pieces), is kept under the keys that every line
    has.  Rows without a pattern are no rules.
    """
    plain = lambda t: (F.length(t) >= GRAM) & ~F.rlike(t, F.lit(r"[^\x00-\x7F]"))
    needs = F.coalesce(F.filter("needs", lambda t: t.isNotNull()), F.array().cast("array<string>"))
    usable = (F.size(needs) > 0) & F.forall(needs, plain)
    keyed = F.transform(
        F.array_distinct(needs),
        lambda t: F.struct(F.lower(F.right(t, F.lit(GRAM))).alias("gram"), t.alias("need")),
    )
    everywhere = F.transform(
        F.sequence(F.lit(0), F.lit(OPEN_PARTS - 1)),
        lambda p: F.struct(_open_key(p).alias("gram"), F.lit("").alias("need")),
    )
    severity = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")) - 1
    exts = F.when(F.size("file_exts") > 0, F.col("file_exts"))
    return rules.where(F.col("pattern").isNotNull()).select(
        F.col("rule_ord").cast("int").alias("rule_ord"), "rule_id", "message", severity.cast("int").alias("severity"),
        exts.alias("exts"), F.startswith("pattern", F.lit("(?i)")).alias("folds"),
        java_pattern(F.col("pattern")).alias("pattern"),
        F.inline(F.when(usable, keyed).otherwise(everywhere)),
    )


def _grams(lowered: Column) -> Column:
    """The distinct pieces of a line that can be keys, which are plain ASCII; one pass over the line."""
    every = rf"(?=([\x00-\x7F]{{{GRAM}}}))"
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(every), F.lit(1)))


def indexed_rule_scan(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule of the table on every added line, all matches kept; equal to ``rule_scan``.

    The index is staged, so that Spark knows its size and decides by it what travels to the lines; no side
    is hinted.  A line is looked up among the texts alone, a far smaller table than the rules; where the rules are
    too many to travel, it goes to them once for each text it holds, not once for each of its pieces.
    """
    index, _ = stage(rule_index(rules).withColumnRenamed("pattern", "_pattern"), "rule-index")
    key = ["gram", "folds", "need"]
    lines = files.select(
        "scan_id", "file_ord", "path", last_dot_ext(F.col("path")).alias("_ext"), F.explode("added").alias("_line")
    ).select("scan_id", "file_ord", "path", "_ext", "_line.*")
    part = F.pmod(F.xxhash64(*_LINE), F.lit(OPEN_PARTS))
    low = F.lower("content")
    looked_up = lines.withColumn(
        "gram", F.explode(F.array_append(_grams(low), _open_key(part)))
    )
    holds = F.contains(F.when(F.col("folds"), low).otherwise(F.col("content")), F.col("need"))
    held = looked_up.join(index.select(*key).distinct(), "gram").where(holds)
    fits = F.col("exts").isNull() | F.array_contains("exts", F.col("_ext"))
    met = held.join(index, key).where(fits & F.rlike(F.col("content"), F.col("_pattern")))
    # a line may hold several texts of one rule
    hits = met.dropDuplicates([*_LINE, "rule_ord"])
    return as_findings(
        hits,
        phase=F.lit(1),
        line=F.col("number"),
        content=trim_space(F.col("content")),
        source=F.lit("fallback"),
    )
