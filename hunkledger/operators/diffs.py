"""Unified-diff parsing as narrow column expressions.

A raw diff is one row, so the parser never shuffles: the text is split into file
sections, hunks and lines with array functions, and line numbers come from positions
in the filtered arrays instead of from windows.  Rows multiply only where the caller
asks for files, hunks or lines.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import BLOCKED_EXTENSIONS, SUPPRESS_MARKER
from ..functions.arrays import drop_first, let
from ..functions.text import WHITE_SPACE, add_wrapping, after, path_ext

_RANGE = r"([+-]?[0-9]+)(?:,([+-]?[0-9]+))?"
HUNK_HEADER = rf"(?s)\A@@ -?{_RANGE} \+?{_RANGE}(?: @@.*)?\z"
HEADER_GROUPS = ("old_start", "old_count", "new_start", "new_count")
_FILE_CUT = r"\n(?=diff --git )"
_HUNK_CUT = r"\n(?=@@ )"


def header_number(header: Column, group: int) -> Column:
    text = F.regexp_extract(header, HUNK_HEADER, group)
    return F.when(text == "", F.lit(1)).otherwise(text.try_cast("bigint"))


def header_ok(header: Column) -> Column:
    numbers = [header_number(header, g).isNotNull() for g in range(1, 5)]
    return F.rlike(header, F.lit(HUNK_HEADER)) & numbers[0] & numbers[1] & numbers[2] & numbers[3]


def _headers(raw: Column) -> Column:
    pieces = drop_first(F.split(F.concat(F.lit("\n"), raw), "\n@@ "))
    return F.transform(pieces, lambda p: F.concat(F.lit("@@ "), F.substring_index(p, "\n", 1)))


def is_blank(raw: Column) -> Column:
    """A diff of white space only counts as empty."""
    # From one end only: that stops at the first other character.
    return F.ltrim(raw, F.lit(WHITE_SPACE)) == ""


def has_bad_header(raw: Column) -> Column:
    """One unreadable hunk header fails the whole diff."""
    return F.contains(raw, F.lit("@@ ")) & F.exists(_headers(raw), lambda h: ~header_ok(h))


def _parts(raw: Column) -> Column:
    """Text before the first file header, then one element per file section."""
    return F.split(F.concat(F.lit("\n"), raw), _FILE_CUT)


def section_path(section: Column) -> Column:
    """Path of the last ``+++ b/`` line of a section, wherever it stands."""
    mark = "\n+++ b/"
    tail = F.substring_index(section, mark, -1)
    return F.when(
        F.contains(section, F.lit(mark)), F.substring_index(tail, "\n", 1)
    ).otherwise(F.lit(""))


def _parsed(diffs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Scan rows with their text cut into parts; only the first part of a lost diff."""
    raw = F.col("raw")
    rated = diffs.select(
        *keys,
        is_blank(raw).alias("is_empty"),
        (~is_blank(raw) & has_bad_header(raw)).alias("is_error"),
        _parts(raw).alias("_parts"),
    )
    lost = F.col("is_empty") | F.col("is_error")
    return rated.withColumn(
        "_parts", F.when(lost, F.slice("_parts", 1, 1)).otherwise(F.col("_parts"))
    )


def _scan_facts(parts: Column, blocked: Iterable[str]) -> list[Column]:
    blocked = list(blocked)
    paths = F.transform(drop_first(parts), section_path)
    kept = F.filter(paths, lambda p: ~path_ext(p).isin(*blocked)) if blocked else paths
    return [(F.size(parts) - 1).alias("n_files"), F.size(kept).alias("n_kept")]


def _scan_keys(diffs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in ("scan_id", "repo", "scan_ts") if c in diffs.columns)


def scan_files(diffs: DataFrame, blocked: Iterable[str] = BLOCKED_EXTENSIONS) -> DataFrame:
    """Per scan: is its diff blank or unreadable, how many files, how many not blocked."""
    keys = _scan_keys(diffs)
    return _parsed(diffs, keys).select(
        *keys, "is_empty", "is_error", *_scan_facts(F.col("_parts"), blocked)
    )


def _sections(parsed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per part of the text; part 0, before the first file header, has
    ``file_ord`` 0.

    A hunk before the first file header is still open when that header comes, so the
    last such hunk, and whatever follows up to the next hunk header, belongs to the
    first file.
    """
    mark = "\n@@ "
    preamble = F.col("_parts")[0]
    orphan = F.when(
        F.contains(preamble, F.lit(mark)),
        F.concat(F.lit(mark), F.substring_index(preamble, mark, -1)),
    ).otherwise(F.lit(""))
    # Every scan has at least one part; the outer form keeps Catalyst from inferring a filter
    # that would parse the text once more.
    rows = parsed.select(
        *keys, orphan.alias("_orphan"), F.posexplode_outer("_parts").alias("file_ord", "_section")
    )
    body = F.concat(
        F.when(F.col("file_ord") == 1, F.col("_orphan")).otherwise(F.lit("")),
        F.lit("\n"),
        F.col("_section"),
    )
    return rows.select(
        *keys,
        "file_ord",
        F.when(F.col("file_ord") > 0, section_path(F.col("_section")))
        .otherwise(F.lit(""))
        .alias("path"),
        F.when(F.col("file_ord") > 0, drop_first(F.split(body, _HUNK_CUT)))
        .otherwise(F.array().cast("array<string>"))
        .alias("hunks"),
    )


def file_sections(diffs: DataFrame, keys: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """One row per file with its path and the texts of its hunks."""
    return _sections(_parsed(diffs, keys), keys).where(F.col("file_ord") > 0)


def sections_and_scans(
    diffs: DataFrame, blocked: Iterable[str] = BLOCKED_EXTENSIONS
) -> DataFrame:
    """The file sections that are not blocked, plus one ``file_ord`` 0 row per scan; every
    row carries the facts of its scan (see ``scan_files``).  One pass over the texts."""
    blocked = list(blocked)
    keys = _scan_keys(diffs)
    facts = ("is_empty", "is_error", "n_files", "n_kept")
    parsed = _parsed(diffs, keys).select(
        *keys, "is_empty", "is_error", *_scan_facts(F.col("_parts"), blocked), "_parts"
    )
    rows = _sections(parsed, (*keys, *facts))
    if not blocked:
        return rows
    return rows.where((F.col("file_ord") == 0) | ~path_ext(F.col("path")).isin(*blocked))


def is_recorded(line: Column) -> Column:
    """Lines a hunk keeps: added, deleted or context, but no file markers."""
    first = F.left(line, F.lit(1))
    return (
        first.isin("+", "-", " ")
        & ~F.startswith(line, F.lit("+++ b/"))
        & ~F.startswith(line, F.lit("--- "))
    )


def _marked(chunk: Column) -> Column:
    """Recorded lines of a hunk text with their position and mark."""
    kept = F.filter(drop_first(F.split(chunk, "\n")), is_recorded)
    return F.transform(
        kept,
        lambda l, i: F.struct(
            (i + 1).alias("line_ord"),
            F.left(l, F.lit(1)).alias("mark"),
            after(l, 1).alias("content"),
        ),
    )


def _numbered_side(marked: Column, skip: str, start: Column) -> Column:
    """Lines of one side of a hunk, numbered from ``start``."""
    return F.transform(
        F.filter(marked, lambda x: x["mark"] != skip),
        lambda x, i: F.struct(
            x["line_ord"].alias("line_ord"),
            x["mark"].alias("mark"),
            x["content"].alias("content"),
            add_wrapping(start, i.cast("bigint")).alias("number"),
        ),
    )


def _with_mark(side: Column, mark: str) -> Column:
    return F.filter(side, lambda x: x["mark"] == mark)


def _both_sides(new_side: Column, old_side: Column) -> Column:
    """All lines of a hunk as ``struct<line_ord,kind,content,number,old_number>``.

    A context line is the k-th context line on either side, so zipping the two
    filtered sides gives it both numbers.
    """

    def line(x: Column, kind: str, number: Column, old_number: Column) -> Column:
        return F.struct(
            x["line_ord"].alias("line_ord"),
            F.lit(kind).alias("kind"),
            x["content"].alias("content"),
            number.alias("number"),
            old_number.alias("old_number"),
        )

    zero = F.lit(0).cast("bigint")
    return F.concat(
        F.transform(_with_mark(new_side, "+"), lambda x: line(x, "add", x["number"], zero)),
        F.transform(_with_mark(old_side, "-"), lambda x: line(x, "del", zero, x["number"])),
        F.zip_with(
            _with_mark(new_side, " "),
            _with_mark(old_side, " "),
            lambda n, o: line(n, "ctx", n["number"], o["number"]),
        ),
    )


def diff_files(diffs: DataFrame, keys: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """One row per file section; files without hunks are kept."""
    return file_sections(diffs, keys).select(*keys, "file_ord", "path")


def hunk_rows(sections: DataFrame, keys: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """One row per hunk of given file sections, with its text in ``chunk``."""
    # The outer form keeps Catalyst from inferring a filter that splits the text again.
    chunks = sections.select(
        *keys, "file_ord", "path", F.posexplode_outer("hunks").alias("_pos", "chunk")
    ).where(F.col("chunk").isNotNull())
    header = F.substring_index(F.col("chunk"), "\n", 1)
    return chunks.select(
        *keys,
        "file_ord",
        "path",
        (F.col("_pos") + 1).alias("hunk_ord"),
        *[header_number(header, i + 1).alias(name) for i, name in enumerate(HEADER_GROUPS)],
        "chunk",
    )


def diff_hunks(diffs: DataFrame, keys: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """One row per hunk with the four numbers of its header."""
    return hunk_rows(file_sections(diffs, keys), keys).select(
        *keys, "file_ord", "hunk_ord", *HEADER_GROUPS
    )


def lines_of_hunks(hunks: DataFrame, keys: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """Numbered line rows of given hunk rows."""
    place = [*keys, "file_ord", "path", "hunk_ord"]
    marked = hunks.select(*place, "old_start", "new_start", _marked(F.col("chunk")).alias("_m"))
    sides = marked.select(
        *place,
        _numbered_side(F.col("_m"), "-", F.col("new_start")).alias("_new"),
        _numbered_side(F.col("_m"), "+", F.col("old_start")).alias("_old"),
    )
    return sides.select(*place, F.inline(_both_sides(F.col("_new"), F.col("_old"))))


def lines_of(sections: DataFrame, keys: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """Numbered line rows of given file sections."""
    return lines_of_hunks(hunk_rows(sections, keys), keys)


def _added(hunks: Column, marker: str) -> Column:
    """Added lines of a file section in order, as
    ``array<struct<hunk_ord,line_ord,content,number,suppressed>>``.

    A line is suppressed when it holds the marker, or when the recorded line right
    before it in its hunk is an added line that holds it.
    """

    def holds(line: Column) -> Column:
        return (line["mark"] == "+") & F.contains(line["content"], F.lit(marker))

    def of_hunk(chunk: Column, pos: Column) -> Column:
        def lines(marked: Column, start: Column) -> Column:
            return F.transform(
                _with_mark(_numbered_side(marked, "-", start), "+"),
                lambda x: F.struct(
                    (pos + 1).alias("hunk_ord"),
                    x["line_ord"].alias("line_ord"),
                    x["content"].alias("content"),
                    x["number"].alias("number"),
                    (
                        holds(x) | F.coalesce(holds(F.get(marked, x["line_ord"] - 2)), F.lit(False))
                    ).alias("suppressed"),
                ),
            )

        # The header is read once for a hunk, not once for each of its lines.
        first = header_number(F.substring_index(chunk, "\n", 1), 3)
        return let(first, lambda start: let(_marked(chunk), lambda marked: lines(marked, start)))

    return F.flatten(F.transform(hunks, of_hunk))


def with_added(sections: DataFrame, marker: str = SUPPRESS_MARKER) -> DataFrame:
    """File rows with their added lines nested in ``added``; replaces the hunk texts.

    Everything after parsing needs added lines only, so the scan operators take these
    rows: one row per file, no shuffle behind them.
    """
    added = _added(F.col("hunks"), marker).alias("added")
    return sections.select(*[c for c in sections.columns if c != "hunks"], added)


def diff_lines(diffs: DataFrame, keys: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """One row per recorded line: kind, text, new-side and old-side number."""
    return lines_of(file_sections(diffs, keys), keys)


def diff_errors(diffs: DataFrame, keys: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """Unreadable diffs with the first header that could not be read."""
    raw = F.col("raw")
    numbered = F.transform(
        F.split(raw, "\n"),
        lambda l, i: F.struct((i + 1).alias("line_no"), l.alias("header")),
    )
    bad = F.filter(
        numbered, lambda x: F.startswith(x["header"], F.lit("@@ ")) & ~header_ok(x["header"])
    )
    return (
        diffs.where(~is_blank(raw) & has_bad_header(raw))
        .select(*keys, F.get(bad, F.lit(0)).alias("_bad"))
        .select(*keys, "_bad.line_no", "_bad.header")
    )
