"""Scanner reports and agent responses with a key twice: the last value counts, whatever ran before in the session."""

import pytest

from hunkledger.operators.agents import parse_responses
from hunkledger.operators.scanner import scanner_report
from hunkledger.sources.audit import decode_audit

REPORT = '{"version":"1","version":"2","results":[{"check_id":"a","check_id":"b","path":"x.go","extra":{"lines":"l","lines":"m"}}]}'
ANSWER = r'{\"findings\":[{\"id\":\"a\",\"id\":\"b\",\"confidence\":0.1,\"confidence\":0.9}]}'
BODY = '{"model":"m","model":"n","choices":[{"message":{"content":"old","content":"' + ANSWER + '"}}]}'


@pytest.fixture(params=[False, True])
def session(spark, request):
    """A new session, before and after a log was read in it."""
    own = spark.newSession()
    if request.param:
        decode_audit(own.createDataFrame([("r", "{}")], "repo string, value string")).collect()
    return own


def test_report(session):
    rows = session.createDataFrame([(1, True, 0, REPORT), (2, True, 0, REPORT + "x")], "scan_id bigint, available boolean, exit_code int, report string")
    got = {r.scan_id: (r.status, [(x.check_id, x.lines) for x in r.results]) for r in scanner_report(rows).collect()}
    assert got == {1: ("ok", [("b", "m")]), 2: ("scanner_error", [])}


def test_response(session):
    schema = "scan_id bigint, file_ord int, file_path string, agent_ord int, agent string, provider string, available boolean, http_status int, body string, latency_ms bigint"
    row = session.createDataFrame([(1, 1, "x.go", 1, "g", "gemini", True, 200, BODY, 5)], schema)
    (got,) = parse_responses(row).collect()
    assert (got.error, [(f.id, f.confidence) for f in got.findings]) == ("", [("b", 0.9)])
