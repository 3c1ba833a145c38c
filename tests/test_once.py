"""What a query needs twice is made once."""

import pytest
from pyspark.sql import functions as F

import registry
from hunkledger.functions.arrays import drop_first
from hunkledger.functions.prefilter import EITHER_S, matches, plain_part, spellings
from hunkledger.operators import diffs as D
from hunkledger.operators import patches


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def small(spark, tmp_path):
    rows = [(i, f"text {i}\nx = eval(payload)\ndelete from t +", "s") for i in range(20)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_the_diffs_are_searched_once_for_two_phases(spark, small, monkeypatch):
    monkeypatch.setattr(registry.patches, "rank_findings", lambda found: found)
    found = registry.build_review_findings(spark, small)
    assert optimized(found).count("Relation [") == 1
    phases = {r.phase: r.n for r in found.groupBy("phase").agg(F.count("*").alias("n")).collect()}
    assert set(phases) == {1, 2} and phases[1] == phases[2] > 0
    place = [c for c in found.columns if c != "phase"]
    assert found.groupBy(*place).count().where("count % 2 <> 0").count() == 0


def test_outcomes_do_not_check_the_patches_again(spark, small):
    outcomes = registry.outcomes_of(spark, small)
    assert outcomes.count() > 0
    read = " ".join(outcomes.inputFiles())
    assert "accepted-patches" in read and "asked-lines" not in read and "patch-hunks" not in read


def test_reads_and_writes_come_from_one_pass(spark):
    edits = spark.createDataFrame(
        [(1, 1, "f", "ctx", 4, 6), (1, 1, "f", "del", 5, 6), (1, 1, "f", "add", 5, 6), (1, 1, "f", "add", 5, 6), (1, 1, "f", "ctx", 6, 6)],
        "scan_id bigint, finding_ord bigint, path string, kind string, at bigint, _end bigint",
    )
    points = patches._footprint(edits)
    got = {(r.point.kind, r.point.at): (r.reads, r.writes) for r in points.collect()}
    assert got == {
        ("line", 4): (True, False), ("gap", 4): (True, False), ("line", 5): (True, True),
        ("gap", 5): (True, True), ("line", 6): (True, False),
    }
    assert points.count() == 5 and optimized(points).count("LogicalRDD") == 1


def test_an_array_is_made_once_to_lose_its_first_element(spark):
    df = spark.createDataFrame([("a\nb\nc",), ("a",), ("",), (None,)], "t string")
    rest = df.select(drop_first(F.split("t", "\n")).alias("r"))
    assert [r.r for r in rest.collect()] == [["b", "c"], [], [], None]
    assert optimized(rest).count("split(") == 1


def test_a_hunk_header_is_read_once_for_all_its_lines(spark):
    chunk = "@@ -3,2 +7,4 @@ f\n+one\n ctx\n-gone\n+two"
    df = spark.createDataFrame([(1, 1, "p", [chunk])], "scan_id bigint, file_ord int, path string, hunks array<string>")
    added = D.with_added(df)
    assert [(x.line_ord, x.content, x.number) for x in added.first().added] == [(1, "one", 7), (4, "two", 9)]
    assert optimized(added).count("regexp_extract(") == 2


def test_blank_diffs_and_their_headers(spark):
    raws = ["", " \n\t", "　\x85", " x ", "@@ a\n@@ b\nx @@ c\n@@ d", "@@ ", "x\n@@ \n@@ e\r", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    rows = df.select("i", D.is_blank(F.col("raw")).alias("blank"), D._headers(F.col("raw")).alias("h")).orderBy("i").collect()
    assert [r.blank for r in rows] == [True, True, True, False, False, False, False, None]
    assert [r.h for r in rows] == [[], [], [], [], ["@@ a", "@@ b", "@@ d"], ["@@ "], ["@@ ", "@@ e\r"], None]


def test_a_need_finds_both_forms_of_s(spark):
    need = f"in{EITHER_S}ert"
    assert spellings(need) == ["insert", need] and spellings("ert") == ["ert"] and plain_part(need) == "ert"
    df = spark.createDataFrame([("INSERT",), (f"IN{EITHER_S}ERT",), ("expert",), (None,)], "t string")
    hit = df.select(matches("(?i)insert|expert", F.col("t"), F.lower("t"), [need]).alias("m"))
    assert [r.m for r in hit.collect()] == [True, True, False, None]


def test_prose_is_not_searched_for_sql():
    from hunkledger.catalogue import LINE_RULES

    (sql,) = [r for r in LINE_RULES if r.rule_id == "fallback-sql-concat"]
    assert not any(s in "an expert certainly never inserted a certificate".replace("inserted", "put") for n in sql.needs for s in spellings(n))
