"""Tokens and scans that arrive out of order, over several runs of the stream."""

import random
from datetime import datetime, timedelta

from hunkledger.operators.bypass import bypass_match, bypass_tokens
from hunkledger.session import work_path
from hunkledger.streaming.bypass import ISSUES, SCANS, bypass_stream

T0 = datetime(2024, 5, 1)
KEEP = ("scan_id", "repo", "scan_ts", "token_id", "reason", "created_at", "expires_at")


def rows_of(df):
    return sorted(tuple(r[c] for c in KEEP) for r in df.collect())


def test_equals_the_batch_join_for_shuffled_batches_and_restarts(spark):
    chance = random.Random(2)
    moment = lambda: T0 + timedelta(minutes=chance.randrange(0, 36 * 60, 20), microseconds=chance.choice((0, 0, 1, 999)))
    issues = [(f"r{chance.randrange(4)}", chance.choice(("", "hot", "fix")), moment(), chance.randrange(0, 9)) for _ in range(150)]
    scans = [(i, f"r{chance.randrange(5)}", moment()) for i in range(250)]
    # the last event closes everything; arrival within the watermark's two days is in any order
    batches = [([], []) for _ in range(4)]
    for side, rows in enumerate((issues, scans)):
        for row in rows:
            batches[chance.randrange(4)][side].append(row)
    batches.append(([], [(900, "other", T0 + timedelta(days=9))]))
    where = [work_path(spark, f"bypass-{n}") for n in ("issues", "scans", "out", "ckpt")]
    for some_issues, some_scans in batches:
        spark.createDataFrame(some_issues, ISSUES).coalesce(1).write.mode("append").parquet(where[0])
        spark.createDataFrame(some_scans, SCANS).coalesce(1).write.mode("append").parquet(where[1])
        bypass_stream(spark, *where, watermark="2 days").awaitTermination()
    want = rows_of(bypass_match(bypass_tokens(spark.createDataFrame(issues, ISSUES)), spark.createDataFrame(scans, SCANS)))
    assert want and rows_of(spark.read.parquet(where[2])) == want
