"""Texts move only where they are needed."""

import pytest
from pyspark.sql import functions as F

import corpus
from hunkledger.functions.keys import may_meet
from hunkledger.operators.patches import patch_check, rank_findings

DOCS = "doc_id bigint, text string, source string"


def stored(spark, path, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_repository_files_are_settled_before_their_texts_move(spark, tmp_path):
    files = corpus.repo_files(spark, stored(spark, tmp_path, [(i, f"text {i}", f"s{i % 2}") for i in range(20)]))
    found = {(r.scan_id, r.path): r.content for r in files.collect()}
    assert found[0, "src/shared/base.py"].endswith("text 0") and found[1, "src/s0/helper.js"].endswith("text 6")
    assert len(found) == files.count() == 4 * (5 + 5 + 1 + 3 * 2 + 5)
    final = files._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert not [line for line in final.splitlines() if "Aggregate" in line and "doc_id" in line and "content" in line]


def test_repository_files_of_repeated_and_missing_ids(spark, tmp_path):
    rows = [(1, "b", "s"), (1, "a", "s"), (1, "a", "s"), (1, "c", "t"), (2, "0", "s"), (None, "x", "s"), (None, None, "t"), (6, "z", None)]
    files = corpus.repo_files(spark, stored(spark, tmp_path, rows))
    found = {(r.scan_id, r.path): (r.content, r.is_dir, r.size) for r in files.collect()}
    assert files.count() == len(found)
    base = "class Base:\n    def run(self):\n        pass\n"
    assert found[0, "src/shared/base.py"] == (base + "a", False, len(base) + 1)
    assert found[0, "src/t/middleware.go"][0].endswith("\nc") and found[0, "src/s/auth_2.py"][0].endswith("\n0")
    assert found[None, "src/shared/base.py"][0] is None and found[None, "src/s/helper.js"][0].endswith("\nx")
    assert found[1, None] == ("", True, 0) or found[1, None][0].endswith("z")


def test_rows_that_meet_nobody_are_left_behind(spark):
    rows = spark.range(100_000).select("id", F.concat(F.lit("p"), "id").alias("path"))
    others = rows.where("id % 100 = 7").unionByName(spark.createDataFrame([(None, "p"), (-1, None)], "id bigint, path string"))
    left = may_meet(rows, others, ["id", "path"])
    assert left.join(others, ["id", "path"]).count() == 1000
    assert left.count() < 1500
    assert may_meet(rows, others.limit(0), ["id", "path"]).count() == 0


@pytest.mark.parametrize("asked", [1, 2, 3])
def test_a_patch_brings_back_only_the_lines_it_names(spark, asked):
    patch = f"diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -{asked} +{asked} @@\n-line{asked}\n+new\n"
    patches = spark.createDataFrame([(1, 1, patch), (1, 2, patch.replace("line", "else"))], "scan_id bigint, finding_ord bigint, patch string")
    files = spark.createDataFrame(
        [(1, "f", False, "line1\nline2\n"), (1, "g", False, "line1\n"), (1, "d", True, "")], "scan_id bigint, path string, is_dir boolean, content string"
    )
    checks = patch_check(patches, files)
    assert {r.finding_ord: r.applies for r in checks.collect()} == {1: asked < 3, 2: False}
    assert "Generate posexplode" not in checks._jdf.queryExecution().optimizedPlan().toString().replace("posexplode_outer", "")


def test_findings_are_searched_once_to_be_ranked(spark):
    found = spark.range(6).select(
        F.lit(1).alias("scan_id"), F.lit(1).alias("phase"), F.lit(1).alias("file_ord"), F.lit(1).alias("hunk_ord"),
        F.col("id").alias("line_ord"), F.lit(1).alias("rule_ord"),
    )
    ranked = rank_findings(found)
    assert sorted(r.finding_ord for r in ranked.collect()) == [1, 2, 3, 4, 5, 6]
    assert "Range" not in ranked._jdf.queryExecution().optimizedPlan().toString()


def test_responses_and_reports_share_one_cut_of_the_diffs(spark, tmp_path, monkeypatch):
    import registry

    sf = stored(spark, tmp_path, [(i, f"text {i}\n\nmore", "s") for i in range(20)])
    spark.createDataFrame([(1, "x")], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    cuts, cut = [], registry.kept_files
    monkeypatch.setattr(registry, "kept_files", lambda *a: cuts.append(1) or cut(*a))
    files = registry.line_counts_of(spark, sf).count()
    assert files and registry.responses_of(spark, sf).count() and registry.reports_of(spark, sf).count() and len(cuts) == 1
    assert files == cut(spark, sf).count()
