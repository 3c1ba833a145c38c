"""The report from daily partials: equal to the whole report, reads few days, counts again what changed."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from hunkledger.plans.partials import refresh_partials, report_from_partials
from hunkledger.plans.report import build_report
from hunkledger.sources.audit import read_audit, write_audit

NOW = "2024-03-01T00:00:00Z"
T0 = datetime(2024, 1, 1)
SCHEMA = "repo string, timestamp string, severity string, action string, rule_id string, source string, log_seq bigint"


def log_rows(seed, days, a_day, repos="aab"):
    rnd = random.Random(seed)
    numbers = dict.fromkeys(repos, 0)
    for day in days:
        for k in range(a_day):
            repo = rnd.choice(repos)
            numbers[repo] += rnd.choice((1, 1, 400))
            at = T0 + timedelta(days=day, seconds=k * 86400 // a_day)
            number = None if rnd.random() < 0.1 else numbers[repo] + seed * 10**6
            stamp = "soon" if rnd.random() < 0.03 else f"{at:%Y-%m-%dT%H:%M:%S}Z"
            yield (f"r{repo}", stamp, rnd.choice(["CRITICAL", "ERROR", "INFO", ""]), rnd.choice(["bypass", "no-verify", "approve"]), f"rule-{rnd.randrange(9)}", rnd.choice(["semgrep", ""]), number)


def outcome(frame):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in frame.collect())


def both(spark, log, partials, out, as_of, days):
    read = report_from_partials(spark, log, partials, out, as_of, days)
    got = spark.read.parquet(f"{out}/as_of={as_of:%Y-%m-%d}")
    want = build_report(read_audit(spark, log, dated=True), as_of, days)
    return outcome(got), outcome(want), read


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("partials")
    log, partials = str(root / "log"), str(root / "partials")
    write_audit(spark.createDataFrame(list(log_rows(1, range(0, 20), 300)), SCHEMA), log, F.lit(NOW))
    first = refresh_partials(spark, log, partials)
    write_audit(spark.createDataFrame(list(log_rows(2, [3, 19, 20, 21], 200)), SCHEMA), log, F.lit(NOW))
    second = refresh_partials(spark, log, partials)
    return root, log, partials, first, second


def test_only_changed_days_are_counted(spark, grown):
    _, log, partials, first, second = grown
    days = [f"2024-01-{d:02d}" for d in range(1, 21)]
    assert [d for d in first if d != "2024-03-01"] == days
    assert [d for d in second if d != "2024-03-01"] == ["2024-01-04", "2024-01-20", "2024-01-21", "2024-01-22"]
    assert refresh_partials(spark, log, partials) == []


@pytest.mark.parametrize("as_of, days", [
    (datetime(2024, 1, 22, 13, 7, 5, tzinfo=timezone.utc), 7), (datetime(2024, 1, 22, tzinfo=timezone.utc), 21),
    (datetime(2024, 1, 9, 23, 59, 59, tzinfo=timezone.utc), 1), (datetime(2025, 1, 1, tzinfo=timezone.utc), 3),
])
def test_equals_the_whole_report(spark, grown, as_of, days):
    root, log, partials, _, _ = grown
    got, want, _ = both(spark, log, partials, str(root / f"out-{days}"), as_of, days)
    assert got == want and (len(got) == 2) == (as_of.year == 2024)


def test_the_other_days_of_the_log_are_not_needed(spark, grown, tmp_path):
    """A log that has only the days the report says it read gives the same report."""
    root, log, partials, _, _ = grown
    as_of = datetime(2024, 1, 21, 13, tzinfo=timezone.utc)
    got, want, read = both(spark, log, partials, str(root / "out-few"), as_of, 18)
    assert got == want and "2024-01-03" in read and len(read) <= 12
    few = str(tmp_path / "few")
    lines = spark.read.text(log).where(F.col("log_date").cast("string").isin(read))
    lines.write.partitionBy("log_date", "repo").text(few)
    report_from_partials(spark, few, partials, str(tmp_path / "out"), as_of, 18)
    assert outcome(spark.read.parquet(str(tmp_path / "out" / "as_of=2024-01-21"))) == got


def test_without_partials_only_the_cut_day_counts(spark, grown, tmp_path):
    _, log, _, _, _ = grown
    as_of = datetime(2024, 1, 9, 12, tzinfo=timezone.utc)
    assert report_from_partials(spark, log, str(tmp_path / "none"), str(tmp_path / "out"), as_of, 1) == ["2024-01-08"]
