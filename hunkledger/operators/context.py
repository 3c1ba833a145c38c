"""Related files of a change: imported files, security-relevant siblings, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalogue import (
    DECLARATION_MARKS,
    IMPORT_MARKS,
    MAX_CONTEXT_BYTES,
    MAX_CONTEXT_FILES,
    MAX_CONTEXT_LINES,
    SIBLING_WORDS,
)
from ..functions.arrays import let, literal_array
from ..functions.keys import may_meet
from ..functions.text import base_name, clean_path, dir_name, path_ext, trim_space
from ..session import stage


def _marks_of(ext: Column, marks: dict[str, tuple[str, ...]]) -> Column:
    table = F.create_map(*[c for k, v in marks.items() for c in (F.lit(k), literal_array(v))])
    return F.try_element_at(table, ext)


def _modules(content: Column) -> Column:
    """Quoted texts that can name a file: in double quotes, then in single quotes."""

    def quoted(quote: str, quote_ord: int) -> Column:
        parts = F.transform(
            F.split(content, quote),
            lambda part, i: F.struct(
                F.lit(quote_ord).alias("quote_ord"), i.alias("part_ord"), part.alias("module")
            ),
        )
        return F.filter(
            parts,
            lambda p: (p["part_ord"] % 2 == 1)
            & (
                F.contains(p["module"], F.lit("."))
                | ~F.contains(p["module"], F.lit("/"))
            ),
        )

    return F.concat(quoted('"', 0), quoted("'", 1))


def import_candidates(files: DataFrame, repo_files: DataFrame) -> DataFrame:
    """Existing paths named in quotes on added lines that look like imports."""
    lines = (
        files.withColumn("ext", path_ext(F.col("path")))
        .withColumn("marks", _marks_of(F.col("ext"), IMPORT_MARKS))
        .where(F.col("marks").isNotNull())
        .select("scan_id", "file_ord", "path", "ext", "marks", F.explode_outer("added").alias("l"))
        .where(F.col("l").isNotNull())
    )
    content = F.col("l.content")
    found = F.filter(
        F.transform("marks", lambda m, i: F.when(F.contains(content, m), i)), lambda i: i.isNotNull()
    )
    named = (
        lines.where(F.rlike(content, F.lit("[\"']")))
        .select("*", F.explode_outer(found).alias("mark_ord"))
        .where(F.col("mark_ord").isNotNull())
        .select("*", F.explode_outer(_modules(content)).alias("m"))
        .where(F.col("m").isNotNull())
    )
    joined = clean_path(
        F.when(F.col("m.module") == "", F.col("dir")).otherwise(
            F.concat(F.col("dir"), F.lit("/"), F.col("m.module"))
        )
    )
    candidates = (
        named.withColumn("dir", dir_name(F.col("path")))
        .withColumn("target", joined)
        .select(
            "scan_id", "file_ord", F.col("l.hunk_ord").alias("hunk_ord"),
            F.col("l.line_ord").alias("line_ord"), "mark_ord", "m.quote_ord", "m.part_ord",
            F.col("path").alias("importer"), "ext",
            F.when(path_ext(F.col("target")) == "", F.concat("target", "ext"))
            .otherwise(F.col("target"))
            .alias("path"),
        )
    )
    return candidates.join(repo_files.select("scan_id", "path"), ["scan_id", "path"], "left_semi")


def sibling_candidates(files: DataFrame, repo_files: DataFrame) -> DataFrame:
    """Files next to a changed file whose name starts with a security word.

    Only the first changed file of each folder offers them: a later one finds the same
    names already taken or refused.  So a folder yields its siblings once, not once per
    changed file.
    """
    offering = (
        files.where(path_ext(F.col("path")).isin(*IMPORT_MARKS))
        .groupBy("scan_id", dir_name(F.col("path")).alias("dir"))
        .agg(F.min("file_ord").alias("file_ord"))
    )
    word = F.lit(None).cast("int")
    for i, text in reversed(list(enumerate(SIBLING_WORDS))):
        word = F.when(F.startswith(base_name(F.col("path")), F.lit(text)), F.lit(i)).otherwise(word)
    named = repo_files.select("scan_id", "path", word.alias("word_ord")).where(
        F.col("word_ord").isNotNull()
    )
    return (
        named.withColumn("dir", dir_name(F.col("path")))
        .join(offering, ["scan_id", "dir"])
        .select("scan_id", "file_ord", "word_ord", "path")
    )


def usable(repo_files: DataFrame, max_bytes: int | None = MAX_CONTEXT_BYTES) -> DataFrame:
    """Files small enough to show; folders and larger files are refused.  ``None``: any size."""
    files = repo_files.where(~F.col("is_dir"))
    return files if max_bytes is None else files.where(F.col("size") <= max_bytes)


def signature_text(
    content: Column, ext: Column, max_lines: int | None = MAX_CONTEXT_LINES
) -> Column:
    """Declaration lines with the two lines after each and a blank one, at most ``max_lines``
    lines (``None``: all); the first lines of the file where it has no declaration."""
    marks = F.coalesce(_marks_of(ext, DECLARATION_MARKS), F.array().cast("array<string>"))

    def declares(line: Column, marks: Column) -> Column:
        text = trim_space(line)
        return (
            (text != "")
            & ~F.startswith(text, F.lit("//"))
            & ~F.startswith(text, F.lit("#"))
            & F.exists(marks, lambda m: F.contains(line, m))
        )

    def found(lines: Column, marks: Column) -> Column:
        numbers = F.transform(lines, lambda line, i: F.when(declares(line, marks), i))
        return F.filter(numbers, lambda i: i.isNotNull())

    def shown(lines: Column, at: Column) -> Column:
        blocks = F.transform(
            at, lambda i: F.concat(F.slice(lines, i + 1, F.lit(3)), F.array(F.lit("")))
        )
        chosen = F.when(F.size(at) > 0, F.flatten(blocks)).otherwise(lines)
        return F.array_join(chosen if max_lines is None else F.slice(chosen, 1, max_lines), "\n")

    return let(
        F.split(content, "\n"),
        lambda lines: let(
            let(marks, lambda m: found(lines, m)), lambda at: shown(lines, at)
        ),
    )


def signatures(
    repo_files: DataFrame,
    max_bytes: int | None = MAX_CONTEXT_BYTES,
    max_lines: int | None = MAX_CONTEXT_LINES,
) -> DataFrame:
    """Signature text of every usable file, by its own extension."""
    text = signature_text(F.col("content"), path_ext(F.col("path")), max_lines)
    return usable(repo_files, max_bytes).select("scan_id", "path", text.alias("content"))


def related_files(
    imports: DataFrame,
    siblings: DataFrame,
    changed: DataFrame,
    repo_files: DataFrame,
    max_files: int | None = MAX_CONTEXT_FILES,
    max_bytes: int | None = MAX_CONTEXT_BYTES,
    max_lines: int | None = MAX_CONTEXT_LINES,
) -> DataFrame:
    """At most ``max_files`` related files per scan (``None``: all), in the order they are found.

    Contents join in last, for the chosen files only; large files and most others never enter a shuffle.
    """
    none = F.lit(0)

    def order(step: int, *parts) -> Column:
        names = ("p1", "p2", "p3", "p4", "p5")
        filled = [*parts, *[none] * (5 - len(parts))]
        return F.struct(
            F.col("file_ord"), F.lit(step).alias("step"),
            *[(F.col(p) if isinstance(p, str) else p).cast("int").alias(n)
              for p, n in zip(filled, names)],
            F.col("path").alias("name"),
        )

    found = imports.select(
        "scan_id", "path",
        order(0, "hunk_ord", "line_ord", "mark_ord", "quote_ord", "part_ord").alias("order"),
        F.concat(F.lit("imported by "), F.col("importer")).alias("reason"),
        "ext",
    ).unionByName(
        siblings.select(
            "scan_id", "path", order(1, "word_ord").alias("order"),
            F.lit("security-relevant sibling file").alias("reason"),
            path_ext(F.col("path")).alias("ext"),
        )
    )
    keys = ["scan_id", "path"]
    fresh = found.join(changed.select(*keys), keys, "left_anti").join(
        usable(repo_files, max_bytes).select(*keys), keys, "left_semi"
    )
    first = fresh.groupBy(*keys).agg(F.min(F.struct("order", "reason", "ext")).alias("first"))
    ranked = first.select(*keys, "first.*").withColumn(
        "slot", F.row_number().over(Window.partitionBy("scan_id").orderBy("order"))
    )
    chosen = ranked.drop("order")
    if max_files is not None:
        chosen = chosen.where(F.col("slot") <= max_files)
    # names only so far; the texts of the others need not move
    chosen, _ = stage(chosen, "chosen-files")
    texts = may_meet(usable(repo_files, max_bytes), chosen, keys)
    return chosen.join(texts.select(*keys, "content"), keys).select(
        "scan_id", "slot", "path", "reason",
        signature_text(F.col("content"), F.col("ext"), max_lines).alias("content"),
    )
