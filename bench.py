"""Headline timings; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the
local cores.  The derived input tables are written before the clock starts; each query
then runs once to warm up and is timed on its second complete run, from building its plan
to its last row.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "diff_lines", "rule_scan", "regex_agent", "parse_responses", "resolve_chain",
    "dedup_findings", "scan_verdict", "related_files", "patch_check", "patch_apply", "review_outcomes", "read_audit",
    "audit_breakdown", "trend", "report_json", "bypass_match",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    from hunkledger.session import local_session
    from registry import QUERIES, forget_results, prepare

    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark, sf_dir)

    timings: dict[str, float] = {}
    for key in HEADLINE:
        for _ in range(2):
            forget_results()  # every run scans for itself
            start = time.perf_counter()
            QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[key] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
