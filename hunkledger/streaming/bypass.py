"""Bypass tokens and scans as they arrive, in any order within the watermark: which scan consumes which token.

A repository has one state: its live token, and the events that the watermark has not passed yet.  When it passes an event, no
earlier one can come any more, so events are settled in order of their time whatever order they arrived in: a token replaces the
live one, a scan uses the live token up, and a token past its expiry goes.  The result is that of ``operators.bypass.bypass_match``.

At equal times the last-issued token and the scan with the smallest id stand for all, so waiting events are bounded by the distinct
times within the watermark's delay.  Events behind the watermark are dropped.  The state lives in RocksDB and is part of the checkpoint.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.bypass import bypass_tokens
from .audit import streaming_session

ISSUES = "repo string, reason string, created_at timestamp, ttl_hours int"
SCANS = "scan_id bigint, repo string, scan_ts timestamp"
WATERMARK = "1 hour"
_TOKEN = "expires bigint, id string, reason string"
_MATCH = "scan_id bigint, repo string, scan_us bigint, token_id string, reason string, created_us bigint, expires_us bigint"


class OneToken(StatefulProcessor):
    """State of one repository; times are microseconds.

    Every call to the state is a round trip, so only the earliest waiting event has a timer: when it
    fires, all that is due is settled and the next one gets its own.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", f"created bigint, {_TOKEN}")
        self.settled = handle.getValueState("settled", "upto bigint")
        self.waiting = handle.getMapState("waiting", "at bigint, side int", f"scan_id bigint, {_TOKEN}")

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for row in rows:
            event = (row["at"], row["side"])
            value = (row["scan_id"], row["expires"], row["id"], row["reason"])
            if self.waiting.containsKey(event):
                other = tuple(self.waiting.getValue(event))
                value = min(value, other) if row["side"] else max(value, other, key=lambda v: v[1:])
            self.waiting.updateValue(event, value)
            first = row["at"] if first is None else min(first, row["at"])
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        from pyspark.sql import Row

        upto = timerValues.getCurrentWatermarkInMs() * 1000
        if self.settled.exists() and self.settled.get()[0] == upto:
            return  # another timer of this batch has done it
        self.settled.update((upto,))
        due, following = [], None
        for event, value in self.waiting.iterator():
            if event[0] <= upto:
                due.append((tuple(event), tuple(value)))
            elif following is None or event[0] < following:
                following = event[0]
        due.sort()
        if following is not None:
            self.handle.registerTimer(-(-following // 1000))
        live = tuple(self.live.get()) if self.live.exists() else None
        for (at, side), (scan_id, expires, token, reason) in due:
            self.waiting.removeKey((at, side))
            if side == 0:
                live = (at, expires, token, reason)
            elif live:
                if at <= live[1]:
                    yield Row(scan_id=scan_id, repo=key[0], scan_us=at, token_id=live[2], reason=live[3], created_us=live[0], expires_us=live[1])
                live = None
        if live and live[1] >= upto:
            self.live.update(live)
            self.handle.registerTimer(live[1] // 1000 + 1)
        else:
            self.live.clear()

    def close(self) -> None:
        pass


def events(issues: DataFrame, scans: DataFrame) -> DataFrame:
    """Tokens (side 0) and scans (side 1) as one stream."""
    tokens = bypass_tokens(issues)
    none = lambda kind: F.lit(None).cast(kind)
    return tokens.select(
        "repo", F.col("created_at").alias("ts"), F.unix_micros("created_at").alias("at"), F.lit(0).alias("side"), none("bigint").alias("scan_id"),
        F.unix_micros("expires_at").alias("expires"), "id", "reason",
    ).unionByName(scans.select(
        "repo", F.col("scan_ts").alias("ts"), F.unix_micros("scan_ts").alias("at"), F.lit(1).alias("side"), "scan_id",
        none("bigint").alias("expires"), none("string").alias("id"), none("string").alias("reason"),
    ))


def match_stream(issues: DataFrame, scans: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Stream of the scans that consume a token, with the columns of ``bypass_match``."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = events(issues, scans).withWatermark("ts", watermark)
    found = rows.groupBy("repo").transformWithState(OneToken(), _MATCH, outputMode="append", timeMode="EventTime")
    time = lambda name: F.timestamp_micros(name)
    return found.select(
        "scan_id", "repo", time("scan_us").alias("scan_ts"), "token_id", "reason", time("created_us").alias("created_at"), time("expires_us").alias("expires_at")
    )


def bypass_stream(
    spark: SparkSession, issues_path: str, scans_path: str, out_path: str, checkpoint: str, watermark: str = WATERMARK, files_per_batch: int = 1000
) -> StreamingQuery:
    """Match the issues and scans that arrive in two parquet folders; the matches the watermark has passed are appended to
    ``out_path``.  Reruns with the same checkpoint take up where the last one ended."""
    own = streaming_session(spark)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def read(schema: str, path: str) -> DataFrame:
        return own.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)

    matches = match_stream(read(ISSUES, issues_path), read(SCANS, scans_path), watermark)
    return (
        matches.writeStream.outputMode("append").format("parquet").option("path", out_path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
