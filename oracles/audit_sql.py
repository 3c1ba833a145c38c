"""Oracle blocks: audit log, report, bypass tokens, streams."""

from __future__ import annotations

import corpus

from .core import block
from .text import sev_rank

AS_OF = "TIMESTAMP '2024-01-31'"
FIELDS = ("timestamp", "action", "rule_id", "path", "severity", "source", "message", "reason", "patch_hash")

block("alog", "SELECT " + ", ".join(f'{sql} AS "{name}"' for name, sql in corpus.AUDIT_FIELDS.items())
      + " FROM (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp FROM events)")
# DuckDB takes the first of two equal keys, so the one that is replaced is taken out.
block("loglines", f"SELECT repo, replace({corpus.AUDIT_LINE}, '{corpus.REPEATED_KEY}', '') AS value FROM alog")
block("plainlines", f"""
SELECT repo, log_seq AS seq, replace(raw, '{corpus.REPEATED_KEY}', '') AS value,
  coalesce(sum(octet_length(encode(raw)) + 1) OVER (PARTITION BY repo ORDER BY log_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
FROM (SELECT repo, log_seq, {corpus.AUDIT_LINE} AS raw FROM alog)""")
_typed = " AND ".join(f"coalesce(json_type(value, '$.{f}'), 'NULL') IN ('VARCHAR', 'NULL')" for f in FIELDS)


def decoded_from(lines: str, number: str) -> str:
    return f"""
SELECT repo, {number} AS log_seq,
  {', '.join(f"coalesce(value->>'$.{f}', '') AS {f if f != 'timestamp' else '"timestamp"'}" for f in FIELDS)},
  coalesce((value->>'$.line')::BIGINT, 0) AS line
FROM (SELECT * FROM {lines} WHERE value <> '' AND json_valid(value))
WHERE json_type(value) IN ('OBJECT', 'NULL') AND {_typed}
  AND coalesce(json_type(value, '$.line'), 'NULL') IN ('UBIGINT', 'BIGINT', 'NULL')"""


block("decoded", decoded_from("loglines", "(value->>'$.log_seq')::BIGINT"))
block("tailed", decoded_from("plainlines", "place"))
block("plainrows", """SELECT * REPLACE (row_number() OVER (PARTITION BY repo ORDER BY log_seq) AS log_seq) FROM tailed""")

RFC = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d+)?(Z|[+-]\d\d:\d\d)$"


def at(e: str) -> str:
    return f"CASE WHEN regexp_matches({e}, '{RFC}') THEN try_cast({e} AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END"


def window(table: str, days: int) -> str:
    return f"""SELECT * FROM (SELECT *, {at('"timestamp"')} AS moment FROM {table})
WHERE moment > {AS_OF} - INTERVAL {days} DAY"""


def blocks_for(prefix: str, table: str, days: int) -> None:
    w = f"{prefix}win"
    block(w, window(table, days))
    block(f"{prefix}bd", f"""
SELECT repo, 'severity' AS dimension, severity AS value, count(*) AS n FROM {w} GROUP BY ALL
UNION ALL SELECT repo, 'action', action, count(*) FROM {w} GROUP BY ALL
UNION ALL SELECT repo, 'rule_id', rule_id, count(*) FROM {w} GROUP BY ALL
UNION ALL SELECT repo, 'source', source, count(*) FROM {w} GROUP BY ALL
UNION ALL SELECT repo, 'total', '', count(*) FROM {w} GROUP BY ALL""")
    block(f"{prefix}top", f"""
SELECT repo, value AS rule_id, n, row_number() OVER (PARTITION BY repo ORDER BY n DESC, value) AS rank
FROM {prefix}bd WHERE dimension = 'rule_id' QUALIFY rank <= 5""")
    block(f"{prefix}hist", f"""
SELECT repo, count(*) AS total_events, count(*) FILTER (action = 'bypass') AS bypass_count,
  count(*) FILTER (action = 'no-verify') AS no_verify_count FROM {w} GROUP BY repo""")
    block(f"{prefix}trend", f"""
SELECT *, CASE WHEN total < 2 OR first_half = second_half THEN 'STABLE'
  WHEN second_half > first_half THEN 'WORSENING' ELSE 'IMPROVING' END AS trend
FROM (SELECT repo, count(*) AS total, count(*) FILTER (rn <= c // 2 AND bad) AS first_half,
        count(*) FILTER (rn > c // 2 AND bad) AS second_half
      FROM (SELECT repo, severity IN ('CRITICAL', 'ERROR') AS bad, count(*) OVER (PARTITION BY repo) AS c,
                   row_number() OVER (PARTITION BY repo ORDER BY log_seq NULLS LAST, moment, severity) AS rn FROM {w}) GROUP BY repo)""")
    maps = [
        f"(SELECT repo, '{{' || string_agg('\"' || value || '\":' || n, ',' ORDER BY value) || '}}' AS {name} "
        f"FROM {prefix}bd WHERE dimension = '{dim}' GROUP BY repo)"
        for dim, name in (("severity", "severity"), ("action", "actions"), ("source", "sources"))
    ]
    block(f"{prefix}rep", f"""
SELECT repo, '2024-01-31T00:00:00Z' AS generated_at, {days} AS period_days, total_events, severity, actions,
  top_rules, sources, bypass_count, no_verify_count, trend
FROM {prefix}hist JOIN {prefix}trend USING (repo) JOIN {maps[0]} USING (repo) JOIN {maps[1]} USING (repo)
JOIN {maps[2]} USING (repo) JOIN (SELECT repo, '[' || string_agg('{{"rule":"' || rule_id || '","count":' || n || '}}', ',' ORDER BY rank)
  || ']' AS top_rules FROM {prefix}top GROUP BY repo) USING (repo)""")


blocks_for("r20", "alog", 20)
blocks_for("r7", "decoded", 7)
blocks_for("rp", "tailed", 7)

block("btok", """
SELECT repo, substr(sha256(repo || '|' || reason || '|' || epoch_us(created_at)), 1, 16) AS id, reason, created_at,
  created_at + to_hours(ttl) AS expires_at
FROM (SELECT 'repo-' || (user_id % 20) AS repo, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'reason ' || (event_id % 3) END AS reason,
        ts AS created_at, user_id % 3 + 1 AS ttl FROM events WHERE event_type = 'signup') WHERE reason <> ''""")
block("escans", """
SELECT event_id AS scan_id, 'repo-' || (user_id % 20) AS repo, ts AS scan_ts,
  CASE WHEN event_type <> 'error' THEN left(md5('c' || event_id), 7) END AS "commit"
FROM events WHERE event_type <> 'signup'""")
block("bmatch", """
SELECT scan_id, repo, scan_ts, id AS token_id, reason, created_at, expires_at FROM (
  SELECT s.scan_id, t.*, s.scan_ts, row_number() OVER (PARTITION BY t.repo, t.created_at ORDER BY s.scan_ts, s.scan_id) AS rn
  FROM escans s ASOF JOIN (SELECT * FROM btok QUALIFY row_number() OVER (PARTITION BY repo, created_at
    ORDER BY expires_at DESC, id DESC, reason DESC) = 1) t ON s.repo = t.repo AND s.scan_ts >= t.created_at)
WHERE rn = 1 AND scan_ts <= expires_at""")

_t = "%Y-%m-%d %H:%M:%S"
_z = "%Y-%m-%dT%H:%M:%SZ"
block("sevents", f"SELECT * FROM (SELECT *, {at('\"timestamp\"')} AS moment FROM decoded) WHERE moment IS NOT NULL")
block("sdays", """
SELECT date_trunc('day', moment)::TIMESTAMP AS d, repo, severity, count(*) AS n FROM sevents GROUP BY ALL""")
block("smark", "SELECT max(moment) - INTERVAL 1 DAY AS wm FROM sevents")

_json = (
    "'{\"timestamp\":\"' || CASE WHEN \"timestamp\" = '' THEN '2024-02-01T00:00:00Z' ELSE \"timestamp\" END || '\",\"action\":\"' || action "
    "|| '\",\"rule_id\":\"' || rule_id || '\",\"path\":\"' || path || '\",\"line\":' || line || ',\"severity\":\"' || severity "
    "|| '\",\"source\":\"' || source || '\",\"message\":\"' || message || '\"' "
    "|| CASE WHEN reason <> '' THEN ',\"reason\":\"' || reason || '\"' ELSE '' END "
    "|| CASE WHEN patch_hash <> '' THEN ',\"patch_hash\":\"' || patch_hash || '\"' ELSE '' END || ',\"log_seq\":' || log_seq || '}'"
)

_bypass_rows = f"""
SELECT repo, strftime(scan_ts, '{_z}') AS "timestamp", 'bypass' AS action, 'bypass-' || token_id AS rule_id, '' AS path, 0 AS line,
  'INFO' AS severity, '' AS source, reason AS message, '' AS reason, '' AS patch_hash FROM bmatch"""
_commit_rows = f"""
SELECT repo, strftime(ts, '{_z}') AS "timestamp", 'no-verify' AS action, 'hook-bypass' AS rule_id, '' AS path, 0 AS line,
  'WARNING' AS severity, 'post-commit-hook' AS source,
  'commit ' || c || ' by user-' || user_id || ' skipped pre-commit hook (--no-verify)' AS message, '' AS reason, '' AS patch_hash
FROM (SELECT *, 'repo-' || (user_id % 20) AS repo, left(md5('c' || event_id), 7) AS c FROM events) e
WHERE NOT EXISTS (SELECT 1 FROM escans s WHERE s.repo = e.repo AND s."commit" = e.c)"""
_review_rows = f"""
SELECT d.repo, strftime(d.scan_ts, '{_z}') AS "timestamp", action, rule_id, path, line, severity, source, message,
  '' AS reason, '' AS patch_hash FROM reviewed r JOIN diffs d ON d.scan_id = r.scan_id"""

QUERIES = {
    "read_audit": "SELECT * FROM decoded",
    "write_audit": f"""
SELECT repo, coalesce(strftime({at('stamped')}, '%Y-%m-%d'), 'undated') AS log_date, {_json} AS json
FROM (SELECT *, CASE WHEN "timestamp" = '' THEN '2024-02-01T00:00:00Z' ELSE "timestamp" END AS stamped FROM alog)""",
    "audit_window": """SELECT repo, log_seq, "timestamp", strftime(moment, '%Y-%m-%d %H:%M:%S.%f') AS moment FROM r20win""",
    "audit_breakdown": "SELECT * FROM r20bd",
    "top_rules": "SELECT * FROM r20top",
    "bypass_history": "SELECT * FROM r20hist",
    "trend": "SELECT * FROM r20trend",
    "report_json": """
SELECT repo, '{"generated_at":"' || generated_at || '","period_days":' || period_days || ',"total_events":' || total_events
  || ',"severity":' || severity || ',"actions":' || actions || ',"top_rules":' || top_rules || ',"sources":' || sources
  || ',"bypass_count":' || bypass_count || ',"no_verify_count":' || no_verify_count || ',"trend":"' || trend || '"}' AS report
FROM r20rep""",
    "report_bars": """
SELECT repo, 4 - rank AS position, value AS severity, n, repeat('█', f) || repeat('░', 20 - f) AS bar
FROM (SELECT b.repo, b.value, b.n, """ + sev_rank("b.value") + """ AS rank, greatest(b.n * 20 // t.n, 1)::INT AS f
      FROM r20bd b JOIN r20bd t ON b.repo = t.repo AND t.dimension = 'total' WHERE b.dimension = 'severity')""",
    "periodic_report": "SELECT * FROM r7rep",
    "partial_report": "SELECT * FROM r7rep",
    "plain_report": "SELECT * FROM rprep",
    "tail_audit": "SELECT * FROM tailed",
    "read_plain_audit": "SELECT * FROM plainrows",
    "bypass_tokens": f"""
SELECT repo, id, reason, strftime(created_at, '{_t}') AS created_at, strftime(expires_at, '{_t}') AS expires_at FROM btok""",
    "bypass_match": f"""
SELECT scan_id, repo, token_id, reason, strftime(scan_ts, '{_t}') AS scan_ts, strftime(created_at, '{_t}') AS created_at FROM bmatch""",
    "bypass_stream": f"""
SELECT scan_id, repo, token_id, reason, strftime(scan_ts, '{_t}') AS scan_ts, strftime(created_at, '{_t}') AS created_at
FROM bmatch WHERE scan_ts <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY
  FROM (SELECT created_at AS ts FROM btok UNION ALL SELECT scan_ts FROM escans))""",
    "bypass_audit": _bypass_rows,
    "unscanned_commits": _commit_rows,
    "audit_append": f"""
SELECT repo, CAST(NULL AS BIGINT) AS log_seq, "timestamp", action, rule_id, path, line, severity, source, message, reason, patch_hash
FROM ({_bypass_rows} UNION ALL {_commit_rows} UNION ALL {_review_rows})""",
    "audit_stream": f"""
SELECT 'daily' AS kind, strftime(d, '{_t}') AS start, strftime(d + INTERVAL 1 DAY, '{_t}') AS "end", repo, severity, n
FROM sdays, smark WHERE d + INTERVAL 1 DAY <= wm
UNION ALL
SELECT 'monthly', strftime(e - INTERVAL 30 DAY, '{_t}'), strftime(e, '{_t}'), repo, severity, sum(n)::BIGINT
FROM (SELECT repo, severity, n, unnest(generate_series(d + INTERVAL 1 DAY, d + INTERVAL 30 DAY, INTERVAL 1 DAY)) AS e FROM sdays), smark
WHERE e <= wm GROUP BY ALL""",
    "scan_stream": "SELECT * FROM verdicts",
    "late_scan_stream": "SELECT * FROM late_verdicts",
}
