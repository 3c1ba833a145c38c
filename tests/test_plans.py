"""Plans that must stay small."""

import registry
from hunkledger.operators import report
from hunkledger.sources.audit import read_audit
from registry import QUERIES


def test_patch_apply_reads_its_inputs_once(spark):
    df = QUERIES["patch_apply"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("FileScan") <= 10 and plan.count("Exchange hash") <= 10


def test_the_audit_window_reads_its_days_only(spark):
    """The operator itself filters the folders by day, and loses nothing by it."""
    sf = "/root/testdata/sf0.001"
    plan = registry.window_of(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan
    for days in (1, 7):
        entries = report.audit_window(registry.dated_audit_of(spark, sf), registry.as_of(), days)
        log = report.audit_window(read_audit(spark, registry.audit_log_path(spark, sf), dated=True), registry.as_of(), days)
        whole = report.audit_window(registry.audit_of(spark, sf), registry.as_of(), days)
        assert entries.count() == whole.count()
        assert "PartitionFilters: [isnotnull(log_date" in log._jdf.queryExecution().executedPlan().toString()
