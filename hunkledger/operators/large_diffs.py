"""Unified diffs of any size, as lines instead of as one text.

``diffs.py`` parses a diff in its own row, which one task must hold.  Here a diff is a table of lines, cut into pieces
of at most 2^16 lines.  What the parser knows after a line is a handful of running counts, the last hunk header and the last file
header.  Counts add up and headers replace each other, so the state after a piece's last line is all that later pieces need
of it: pieces are counted apart, their states are added in order (one small row a piece), and then every piece numbers its lines with what
came before it.  No window spans more than a piece's lines or a diff's pieces.

The results equal those of ``diffs.py`` on the same text.  ``keys`` must name one diff.  Lines whose text is NULL count as empty;
a diff without lines has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import add_wrapping, after, trim_space
from ..session import drop_stage, stage
from .diffs import HEADER_GROUPS, header_number, header_ok, is_recorded

PIECE_BITS = 16
_COUNTS = ("files", "hunks", "kept", "new", "old")


@dataclass(frozen=True)
class CutDiffs:
    """Diffs cut into pieces: their lines with running counts within the piece, and a staged row for each piece with the state
    before it."""

    lines: DataFrame
    pieces: DataFrame
    keys: tuple[str, ...]
    staged: str

    def release(self) -> None:
        """Delete the staged table; nothing derived from this can be read afterwards."""
        drop_stage(self.pieces.sparkSession, self.staged)


def split_lines(diffs: DataFrame, keys: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """The lines of diffs that are one text each: keys, line_no, text."""
    return diffs.select(*keys, F.posexplode(F.split("raw", "\n")).alias("line_no", "text"))


def _running(lines: DataFrame, keys: tuple[str, ...], piece_bits: int) -> DataFrame:
    """Lines with what the parser knows after each, counted from the start of its piece."""
    text = F.coalesce("text", F.lit(""))
    number = F.col("line_no").cast("bigint")
    mark = F.left(text, F.lit(1))
    kept = is_recorded(text)
    is_file, is_hunk = F.startswith(text, F.lit("diff --git ")), F.startswith(text, F.lit("@@ "))
    counted = {"files": is_file, "hunks": is_hunk, "kept": kept, "new": kept & (mark != "-"), "old": kept & (mark != "+")}
    upto = Window.partitionBy(*keys, "piece").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select(
        *keys, F.shiftright(number, piece_bits).alias("piece"), number.alias("line_no"), text.alias("text"),
        is_file.alias("is_file"), is_hunk.alias("is_hunk"), kept.alias("is_kept"),
        *[c.cast("bigint").alias(f"_{name}") for name, c in counted.items()],
    )
    numbered = rows.select(
        *keys, "piece", "line_no", "text", "is_file", "is_hunk", "is_kept",
        F.count(F.lit(1)).over(upto).alias("lines"), *[F.sum(f"_{name}").over(upto).alias(name) for name in _COUNTS],
    )
    heads = [header_number(F.col("text"), i + 1).alias(name) for i, name in enumerate(HEADER_GROUPS)]
    return numbered.select(
        "*",
        F.last(F.when(F.col("is_hunk"), F.struct(*_COUNTS, *heads)), True).over(upto).alias("hunk"),
        F.last(F.when(F.col("is_file"), F.struct("files", "hunks")), True).over(upto).alias("file"),
    )


def _states(running: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A row for each piece: the state after its last line, and what its diff must be told of it."""
    text = F.col("text")
    path = F.when(F.startswith(text, F.lit("+++ b/")), F.struct("line_no", "files", after(text, 6).alias("path")))
    bad = F.when(F.col("is_hunk") & ~header_ok(text), F.struct(F.col("lines").alias("line_no"), text.alias("header")))
    return running.groupBy(*keys, "piece").agg(
        F.max_by(F.struct("lines", *_COUNTS, "hunk", "file"), "line_no").alias("after"),
        F.max(F.when(F.col("files") == 0, F.col("hunks")).otherwise(0)).alias("orphans"),
        F.min(bad).alias("bad"),
        F.collect_list(path).alias("paths"),
        F.bool_and(trim_space(text) == "").alias("is_blank"),
    )


def _unit(files: Column) -> Column:
    """The file a line counts for: what stands before the first file header may belong to the first file."""
    return F.greatest(files, F.lit(1).cast("bigint"))


def _moved(hunk: Column, by: dict[str, Column]) -> Column:
    """A hunk header with its counts from the start of the diff."""
    counts = [(hunk[name] + by[name]).alias(name) for name in _COUNTS]
    return F.when(hunk.isNotNull(), F.struct(*counts, *[hunk[name].alias(name) for name in HEADER_GROUPS]))


def _reset(file: Column, files: Column, hunks: Column) -> Column:
    """Hunks up to a file header, unless it is the diff's first, which closes no hunk."""
    return F.when(file["files"] + files >= 2, file["hunks"] + hunks)


def _placed(states: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The pieces with the state before each, and the facts of the whole diff."""
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    start = {name: F.col(f"{name}_0") for name in ("lines", *_COUNTS)}
    counted = states.select(
        "*", *[F.coalesce(F.sum(F.col("after")[name]).over(before), zero).alias(f"{name}_0") for name in start]
    )
    told = counted.select(
        "*",
        F.last(_moved(F.col("after.hunk"), start), True).over(before).alias("hunk_0"),
        F.coalesce(F.last(_reset(F.col("after.file"), start["files"], start["hunks"]), True).over(before), zero).alias("reset_0"),
        F.sum(F.when(start["files"] == 0, F.col("orphans")).otherwise(0)).over(whole).alias("_orphans"),
        F.sum("after.files").over(whole).alias("n_files"),
        F.max(F.col("bad").isNotNull()).over(whole).alias("is_error"),
        F.min("is_blank").over(whole).alias("is_empty"),
    )
    # Only the last hunk before the first file header is still open when that header comes.
    return told.withColumn("lost_hunks", F.greatest(F.col("_orphans") - 1, zero)).drop("_orphans")


def cut_diffs(lines: DataFrame, keys: tuple[str, ...] = ("scan_id",), piece_bits: int = PIECE_BITS) -> CutDiffs:
    """Cut diffs given as lines (keys, line_no, text) into pieces of at most ``2 ** piece_bits`` lines.

    ``line_no`` orders a diff's lines and may have gaps.  The lines are read once for the states, which are staged, and once more by
    whoever takes hunks or lines.
    """
    running = _running(lines, keys, piece_bits)
    pieces, staged = stage(_placed(_states(running, keys), keys), "diff-pieces")
    return CutDiffs(running, pieces, keys, staged)


def _file_paths(cut: CutDiffs) -> DataFrame:
    """The last path line of every file that has one."""
    named = cut.pieces.select(*cut.keys, "files_0", F.explode("paths").alias("p")).select(
        *cut.keys, (F.col("files_0") + F.col("p.files")).alias("file_ord"), "p.line_no", "p.path"
    )
    return named.where("file_ord > 0").groupBy(*cut.keys, "file_ord").agg(F.max_by("path", "line_no").alias("path"))


def _with_paths(files: DataFrame, cut: CutDiffs) -> DataFrame:
    found = files.join(_file_paths(cut), [*cut.keys, "file_ord"], "left")
    return found.withColumn("path", F.coalesce("path", F.lit("")))


def large_diff_files(cut: CutDiffs) -> DataFrame:
    """One row per file section, as ``diffs.diff_files``; reads the staged pieces only."""
    first, last = F.col("files_0") + 1, F.col("files_0") + F.col("after.files")
    files = cut.pieces.where(~F.col("is_error") & (last >= first)).select(
        *cut.keys, F.explode(F.sequence(first, last)).alias("file_ord")
    )
    return _with_paths(files, cut).select(*cut.keys, F.col("file_ord").cast("int").alias("file_ord"), "path")


def large_scan_facts(cut: CutDiffs) -> DataFrame:
    """Per diff: is it blank or unreadable, and how many files it has (none if it is either)."""
    return cut.pieces.groupBy(*cut.keys).agg(
        F.first("is_empty").alias("is_empty"), F.first("is_error").alias("is_error"),
        F.first(F.when(F.col("is_error"), 0).otherwise(F.col("n_files"))).alias("n_files"),
    )


def large_diff_errors(cut: CutDiffs) -> DataFrame:
    """Unreadable diffs with their first unreadable header, as ``diffs.diff_errors``."""
    at = F.struct((F.col("bad.line_no") + F.col("lines_0")).cast("int").alias("line_no"), F.col("bad.header").alias("header"))
    return cut.pieces.where("bad IS NOT NULL").groupBy(*cut.keys).agg(F.min(at).alias("_bad")).select(*cut.keys, "_bad.*")


def _in_hunks(rows: DataFrame, told: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The given lines with their place in the whole diff; those in no hunk of a file are left out."""
    start = {name: F.col(f"{name}_0") for name in _COUNTS}
    found = rows.join(told, [*keys, "piece"]).select(
        *rows.columns, *[c for c in told.columns if c not in (*keys, "piece")],
        _unit(F.col("files") + start["files"]).alias("file_ord"),
        F.coalesce(_moved(F.col("hunk"), start), F.col("hunk_0")).alias("at"),
        F.coalesce(_reset(F.col("file"), start["files"], start["hunks"]), F.col("reset_0")).alias("reset"),
    )
    lost = F.when(F.col("file_ord") == 1, F.col("lost_hunks")).otherwise(0)
    return found.withColumn("hunk_ord", F.col("hunks") + start["hunks"] - F.col("reset") - lost).where(
        (F.col("file_ord") == _unit(F.col("at.files"))) & (F.col("hunk_ord") > 0)
    )


def _told(cut: CutDiffs) -> DataFrame:
    """Of each readable piece what its lines have to know."""
    return cut.pieces.where(~F.col("is_error") & (F.col("n_files") > 0)).select(
        *cut.keys, "piece", *[f"{name}_0" for name in _COUNTS], "hunk_0", "reset_0", "lost_hunks"
    )


def _ordinals() -> list[Column]:
    return [F.col(name).cast("int").alias(name) for name in ("file_ord", "hunk_ord")]


def large_diff_hunks(cut: CutDiffs) -> DataFrame:
    """One row per hunk with the four numbers of its header, as ``diffs.diff_hunks``."""
    return _in_hunks(cut.lines.where("is_hunk"), _told(cut), cut.keys).select(
        *cut.keys, *_ordinals(), *[F.col("at")[name].alias(name) for name in HEADER_GROUPS]
    )


def large_diff_lines(cut: CutDiffs) -> DataFrame:
    """One row per recorded line, as ``diffs.diff_lines``.

    A piece's row brings the paths of the files it touches, at most one a line, so the lines meet them without another
    shuffle, however many lines a file has.
    """
    first, last = _unit(F.col("files_0")), F.col("files_0") + F.col("after.files")
    touched = cut.pieces.where(~F.col("is_error") & (F.col("n_files") > 0)).select(
        *cut.keys, "piece", F.explode(F.sequence(first, _unit(last))).alias("file_ord")
    )
    paths = _with_paths(touched, cut).groupBy(*cut.keys, "piece").agg(
        F.array_sort(F.collect_list(F.struct("file_ord", "path"))).alias("_paths")
    )
    told = _told(cut).join(paths, [*cut.keys, "piece"])
    # Windows first, then the filter: every line counts, the recorded ones come out.
    rows = _in_hunks(cut.lines.where("is_kept"), told, cut.keys)
    mark = F.left("text", F.lit(1))
    zero = F.lit(0).cast("bigint")

    def number(side: str, header: str) -> Column:
        k = F.col(side) + F.col(f"{side}_0") - F.col("at")[side] - 1
        return add_wrapping(F.col("at")[header], k)

    return rows.select(
        *cut.keys, *_ordinals()[:1],
        F.get("_paths", (F.col("file_ord") - first).cast("int"))["path"].alias("path"), *_ordinals()[1:],
        (F.col("kept") + F.col("kept_0") - F.col("at.kept")).cast("int").alias("line_ord"),
        F.when(mark == "+", F.lit("add")).when(mark == "-", F.lit("del")).otherwise(F.lit("ctx")).alias("kind"),
        after(F.col("text"), 1).alias("content"),
        F.when(mark == "-", zero).otherwise(number("new", "new_start")).alias("number"),
        F.when(mark == "+", zero).otherwise(number("old", "old_start")).alias("old_number"),
    )
