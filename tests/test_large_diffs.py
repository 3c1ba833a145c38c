"""Diffs as lines in pieces: equal to the parser that takes a diff whole, wherever they are cut."""

import pytest

from hunkledger.operators import diffs as D
from hunkledger.operators import large_diffs as L
from hunkledger.sources.diffs import read_diff_files, read_diff_lines
from test_diffs import EDGE, SCHEMA, random_diffs

CUT = [
    "+a\n@@ -1 +1 @@\n+b\n@@ -2 +3 @@\n+c\n c\ndiff --git a b\n+d\n+++ b/one\n@@ -5 +7 @@\n-e\ndiff --git c d\n+no hunk\n@@ -8 +9 @@\n f\n+++ b/two",
    "diff --git a b\n+++ b/first\n+++ b/last\ndiff --git c d\ndiff --git e f\n@@ -1 +1 @@\n" + "\n".join("+ -"[i % 3] + str(i) for i in range(40)),
    "diff --git a b\n@@ -1 +1 @@\n+a\n@@ -x +1 @@\n+b\n@@ -y +1 @@",
    "",
]


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.fixture(scope="module")
def whole(spark):
    raws = EDGE + CUT + list(random_diffs(600, 23))
    df = spark.createDataFrame(list(enumerate(raws)), SCHEMA).cache()
    return df, {
        "files": rows(D.diff_files(df)), "hunks": rows(D.diff_hunks(df)), "errors": rows(D.diff_errors(df)),
        "lines": rows(D.diff_lines(df).select(*LINE)), "facts": rows(D.scan_files(df, ()).drop("n_kept")),
    }


LINE = ("scan_id", "file_ord", "path", "hunk_ord", "line_ord", "kind", "content", "number", "old_number")


@pytest.mark.parametrize("piece_bits", [0, 1, 2, 16])
def test_cut_anywhere(spark, whole, piece_bits):
    df, want = whole
    cut = L.cut_diffs(L.split_lines(df), piece_bits=piece_bits)
    assert rows(L.large_diff_files(cut)) == want["files"]
    assert rows(L.large_diff_hunks(cut)) == want["hunks"]
    assert rows(L.large_diff_errors(cut)) == want["errors"]
    assert rows(L.large_diff_lines(cut).select(*LINE)) == want["lines"]
    assert rows(L.large_scan_facts(cut)) == want["facts"]
    assert [f.dataType for f in L.large_diff_lines(cut).schema] == [f.dataType for f in D.diff_lines(df).schema]
    cut.release()


def test_empty_table_and_null_text(spark):
    schema = "scan_id bigint, line_no bigint, text string, piece string"
    none = L.cut_diffs(spark.createDataFrame([], schema))
    assert rows(L.large_diff_lines(none)) == rows(L.large_diff_files(none)) == rows(L.large_scan_facts(none)) == []
    lines = ["diff --git a b", None, "@@ -1 +4 @@", "+x", None, " y"]
    # gaps between numbers do not matter, nor do other columns
    some = L.cut_diffs(spark.createDataFrame([(1, i * 10, t, "p") for i, t in enumerate(lines)], schema), piece_bits=4)
    assert [r[5:] for r in rows(L.large_diff_lines(some).select(*LINE))] == [("add", "x", 4, 0), ("ctx", "y", 5, 1)]


def test_files_are_read_in_splits(spark, tmp_path):
    """A file that several tasks read gives what the same file gives whole."""
    (tmp_path / "repo-1").mkdir()
    body = [f"diff --git a/f{i} b/f{i}\n+++ b/f{i}\n@@ -1,3 +{i},3 @@\n a\n-b {'x' * 200}\n+c\n d" for i in range(1, 12001)]
    (tmp_path / "repo-1" / "big.diff").write_text("\n".join(body) + "\n")
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        lines = read_diff_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 2
        cut = L.cut_diffs(lines, ("scan_id", "repo"), piece_bits=10)
        got = L.large_diff_lines(cut).select("repo", *LINE)
        want = D.diff_lines(read_diff_files(spark, str(tmp_path)), ("scan_id", "repo")).select("repo", *LINE)
        assert got.count() == 48000
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
