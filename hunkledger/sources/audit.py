"""The append-only audit log: JSON lines in, JSON lines out."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strict_json as J
from ..functions.arrays import held
from ..functions.text import folder_of, split_place
from ..functions.times import parse_rfc3339, rfc3339
from ..schemas import AUDIT_COLUMNS, AUDIT_TEXT_FIELDS, UNDATED


def decode_audit(lines: DataFrame) -> DataFrame:
    """Audit entries from text lines in ``value``; other columns pass through.

    Blank lines, lines that are not exactly one JSON object (or null), and lines with a
    field of the wrong type are dropped.  Missing and null fields take their zero value.
    Keys are matched as written, in lower case; of a repeated key the last value counts.
    A line without ``log_seq`` gets NULL; the report orders such lines by time.
    """
    J.keep_last_key(lines.sparkSession)
    keep = [c for c in lines.columns if c != "value"]
    doc = F.col("_doc")
    parsed = lines.where(F.col("value") != "").select(
        *keep, held(J.strict_variant(F.col("value"))).alias("_doc")
    )
    ok = doc.isNotNull() & J.is_object(doc) & J.is_int(doc, "$.line")
    for name in AUDIT_TEXT_FIELDS:
        ok = ok & J.is_text(doc, f"$.{name}")
    columns: dict[str, Column] = {n: J.text_at(doc, f"$.{n}") for n in AUDIT_TEXT_FIELDS}
    columns["line"] = J.long_at(doc, "$.line")
    if "log_seq" not in keep:
        columns["log_seq"] = F.try_variant_get(doc, "$.log_seq", "bigint")
    return parsed.where(ok).select(*keep, *[c.alias(n) for n, c in columns.items()])


def log_lines(spark: SparkSession, path: str, reader=None) -> DataFrame:
    """Text lines of a ``write_audit`` folder with the columns of its partitions: ``repo``,
    and ``log_date`` where the log is divided by day too."""
    parts = [c for c in spark.read.text(path).columns if c != "value"]
    schema = ", ".join(f"`{c}` string" for c in ["value", *parts])
    return (reader or spark.read).schema(schema).option("lineSep", "\n").format("text").load(path)


def read_audit(
    spark: SparkSession, path: str, since: date | None = None, dated: bool = False
) -> DataFrame:
    """Audit log written by ``write_audit``, with ``log_seq`` in each line, since a folder of
    files has no order of its own.  With ``dated``, ``log_date`` stays where the log has it, so that
    ``audit_window`` can prune by it.

    With ``since``, only the days from then on are read, where the log is divided by day;
    entries without a valid time have no day and are left out.
    """
    lines = log_lines(spark, path)
    if since is not None and "log_date" in lines.columns:
        lines = lines.where((F.col("log_date") >= since.isoformat()) & (F.col("log_date") != UNDATED))
    day = ["log_date"] if dated and "log_date" in lines.columns else []
    return decode_audit(lines).select(*AUDIT_COLUMNS, *day)


def read_plain_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit logs as the command-line tool keeps them: one ``<repo>/audit.jsonl`` each.

    Lines carry no number, so ``log_seq`` is made from where a line stands: the start of
    its file split, then its index in the task reading that split.  That keeps file order
    and needs no shuffle.  Splits must be at least 1 MiB.
    """
    files = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    lines = files.select(
        folder_of(F.col("_metadata.file_path")).alias("repo"),
        split_place().alias("log_seq"),
        "value",
    )
    return decode_audit(lines).select(*AUDIT_COLUMNS)


def with_audit_columns(entries: DataFrame, now: Column) -> DataFrame:
    """Entries with every column of the log: what is missing or NULL takes its zero value, a
    missing time becomes ``now``, and an entry may have no log number."""
    have = set(entries.columns)

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in have else F.lit("")

    stamp = F.when(zero("timestamp") == "", now).otherwise(zero("timestamp"))
    line = F.coalesce("line", F.lit(0)) if "line" in have else F.lit(0)
    number = F.col("log_seq") if "log_seq" in have else F.lit(None)
    texts = {name: zero(name) for name in AUDIT_TEXT_FIELDS} | {"timestamp": stamp}
    columns = texts | {"repo": F.col("repo"), "line": line.cast("bigint"), "log_seq": number.cast("bigint")}
    return entries.select(*[columns[name].alias(name) for name in AUDIT_COLUMNS])


def audit_line() -> Column:
    """JSON text of a complete entry; empty reason and patch hash and a missing log number are
    left out."""
    plain = ("timestamp", "action", "rule_id", "path", "line", "severity", "source", "message")
    return F.to_json(
        F.struct(
            *plain, F.nullif("reason", F.lit("")).alias("reason"),
            F.nullif("patch_hash", F.lit("")).alias("patch_hash"), F.col("log_seq"),
        ),
        {"ignoreNullFields": "true"},
    )


def log_day(timestamp: Column) -> Column:
    """The ``log_date`` of an entry: the UTC day of its time."""
    return F.coalesce(F.left(rfc3339(parse_rfc3339(timestamp)), F.lit(10)), F.lit(UNDATED))


def write_audit(entries: DataFrame, path: str, now: Column) -> None:
    """Append entries, one folder per day and repository.  ``now`` is an RFC 3339 text column.

    Only ``repo`` must be there; the rows of ``bypass_audit``, ``unscanned_commits`` and
    ``review_audit`` can be appended as they are.  Rows are gathered by folder first, and
    a folder with very many rows is cut again, so files are neither tiny nor endless.
    """
    lines = with_audit_columns(entries, now).select(
        log_day(F.col("timestamp")).alias("log_date"), "repo", audit_line().alias("value")
    )
    gathered = lines.hint("rebalance", "log_date", "repo")
    gathered.write.mode("append").partitionBy("log_date", "repo").text(path)
