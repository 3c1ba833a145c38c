"""Oracle blocks: agent requests, recorded responses, chain, scanner reports, gate."""

from __future__ import annotations

import re

import corpus
from hunkledger.catalogue import (
    AGENT_RULES,
    GEMINI_AGENT,
    LINE_RULES,
    OPENROUTER_AGENT,
    REGEX_AGENT,
    RULES_VERSION,
    SYSTEM_PROMPT,
)

from .core import BLOCKS, block, lit
from .text import path_ext, sev_name, sev_rank, trim

NL = "chr(10)"

block("areq", f"""
SELECT scan_id, file_ord, path AS file_path, {path_ext('path')} AS language, t AS added_lines,
       len(string_split(t, {NL})) AS added_count
FROM (SELECT scan_id, file_ord, path, {trim(f"string_agg(content, {NL} ORDER BY hunk_ord, line_ord)")} AS t
      FROM adds GROUP BY ALL) WHERE t <> ''""")

_first = " ".join(
    f"WHEN regexp_matches(line, {lit(r.pattern)}) THEN {i}" for i, r in enumerate(AGENT_RULES, 1)
)
_snip = trim("line")
block("arules", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {lit(r.vuln_class)}, {lit(r.severity)}, {lit(r.cwe)}, {lit(r.description)}, {round(r.confidence * 100)})"
    for i, r in enumerate(AGENT_RULES, 1)) + ") t(rule, cls, sev, cwe, descr, pct)")
block("alines", f"""
SELECT scan_id, file_ord, file_path, unnest(string_split(added_lines, {NL})) AS line,
       generate_subscripts(string_split(added_lines, {NL}), 1) AS n FROM areq""")
block("ahits", f"""
SELECT *, CASE WHEN strlen(s) <= 120 THEN s ELSE cut || CASE WHEN strlen(cut) < 120 THEN chr(65533) ELSE '' END END AS snippet,
       substr(sha256(file_path || ':' || n || ':' || cls), 1, 8) AS id
FROM (SELECT *, left(s, coalesce(list_max(list_filter(range(1, 121), lambda k: strlen(left(s, k)) <= 120)), 0)::INT) AS cut
      FROM (SELECT *, {_snip} AS s FROM (SELECT *, CASE {_first} END AS rule FROM alines) WHERE rule IS NOT NULL)
      JOIN arules USING (rule))""")


def wire(*parts: str) -> str:
    return "concat_ws('|', " + ", ".join(parts) + ")"


block("abuiltin", f"""
SELECT scan_id, file_ord, file_path,
  coalesce(string_agg({wire('id', 'sev', 'cls', 'descr', 'n', 'snippet', 'pct', 'cwe', "''", "descr || ' — manual remediation required'", "'false'")}, {NL} ORDER BY n) FILTER (rule IS NOT NULL), '') AS findings,
  coalesce(max(pct), 0) AS max_pct, count(rule) AS n_findings
FROM areq LEFT JOIN ahits USING (scan_id, file_ord, file_path) GROUP BY ALL""")

block("repos", f"""
SELECT 'repo-' || n AS repo, n % 2 = 0 AS g, n % 3 = 0 AS o, n % 5 = 0 AS l
FROM (SELECT DISTINCT doc_id // 5 % 10 AS n FROM documents)""")
block("chains", f"""
SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY k) AS agent_ord, agent, provider FROM (
  SELECT repo, 1 AS k, {lit(GEMINI_AGENT)} AS agent, 'gemini' AS provider FROM repos WHERE g
  UNION ALL SELECT repo, 2, {lit(OPENROUTER_AGENT)}, 'openrouter' FROM repos WHERE o
  UNION ALL SELECT repo, 3, {lit('ollama-' + corpus.CODE_MODEL)}, 'ollama' FROM repos WHERE l
  UNION ALL SELECT repo, 4, {lit(REGEX_AGENT)}, 'builtin' FROM repos)""")
block("aresp", f"""
SELECT scan_id, file_ord, file_path, agent_ord, agent, provider, n % 13 <> 0 AS available,
       {corpus.RESPONSE_STATUS} AS http_status, {corpus.RESPONSE_BODY} AS body, n % 900 + 100 AS latency_ms
FROM (SELECT *, scan_id + file_ord + agent_ord AS n
      FROM areq JOIN chains ON repo = 'repo-' || scan_id % 10 WHERE provider <> 'builtin')""")
block("astatus", """
SELECT *, CASE WHEN http_status = 200 THEN ''
  WHEN provider = 'gemini' THEN CASE http_status WHEN 403 THEN 'gemini: 403 forbidden (region block or bad key)'
       WHEN 429 THEN 'gemini: 429 rate limited' ELSE 'gemini: unexpected status ' || http_status END
  WHEN provider = 'openrouter' THEN CASE http_status WHEN 401 THEN 'openrouter: 401 unauthorized'
       WHEN 429 THEN 'openrouter: 429 rate limited' WHEN 503 THEN 'openrouter: 503 service unavailable'
       ELSE 'openrouter: unexpected status ' || http_status END
  ELSE 'ollama: status ' || http_status END AS status_error
FROM aresp""")

# Text after the first value of a response is allowed, so the corpus' tail is cut off.
block("aouter", """
SELECT *, regexp_replace(body, '\\} trailing$', '}') AS doc, json_valid(regexp_replace(body, '\\} trailing$', '}')) AS valid
FROM astatus""")
_content = "CASE WHEN valid THEN coalesce(json_extract_string(doc, '$.choices[0].message.content'), '') ELSE '' END"
_opened = (
    "CASE WHEN starts_with(t, '```json') THEN substr(t, 8) WHEN starts_with(t, '```') THEN substr(t, 4) ELSE t END"
)
block("ainner", f"""
SELECT *, replace({trim("CASE WHEN ends_with(o, '```') THEN left(o, length(o) - 3) ELSE o END")}, '{corpus.REPEATED_ID}', '') AS ans
FROM (SELECT *, {_opened} AS o FROM (SELECT *, {trim(_content)} AS t FROM aouter))""")
_bad_line = (
    "len(list_filter(CASE WHEN json_type(ans, '$.findings') = 'ARRAY' THEN json_extract(ans, '$.findings[*]') ELSE [] END, "
    "lambda f: json_type(f, '$.line_number') NOT IN ('UBIGINT', 'BIGINT', 'NULL'))) > 0"
)
block("aerr", f"""
SELECT *, CASE WHEN status_error <> '' THEN status_error
  WHEN NOT valid THEN 'decode response'
  WHEN coalesce(json_type(doc, '$.choices'), 'NULL') NOT IN ('ARRAY', 'NULL') THEN 'decode response'
  WHEN coalesce(json_array_length(doc, '$.choices'), 0) = 0 THEN 'response contained no choices'
  WHEN NOT json_valid(ans) THEN 'unmarshal findings'
  WHEN json_type(ans) NOT IN ('OBJECT', 'NULL') THEN 'unmarshal findings'
  WHEN coalesce(json_type(ans, '$.findings'), 'NULL') NOT IN ('ARRAY', 'NULL') THEN 'unmarshal findings'
  WHEN {_bad_line} THEN 'unmarshal findings' ELSE '' END AS error
FROM ainner""")
block("afs", """
SELECT scan_id, file_ord, agent_ord, i, f->>'$.id' AS id, f->>'$.severity' AS sev, f->>'$.vuln_class' AS cls,
  f->>'$.description' AS descr, (f->>'$.line_number')::BIGINT AS n, f->>'$.code_snippet' AS snippet,
  round((f->>'$.confidence')::DOUBLE * 100)::INT AS pct, f->>'$.cwe' AS cwe, f->>'$.fix.fixed_line' AS fixed,
  f->>'$.fix.explanation' AS why, (f->>'$.fix.automated')::BOOLEAN AS automated
FROM (SELECT scan_id, file_ord, agent_ord, unnest(fs) AS f, generate_subscripts(fs, 1) AS i
      FROM (SELECT *, CASE WHEN json_type(ans, '$.findings') = 'ARRAY' THEN json_extract(ans, '$.findings[*]') ELSE [] END AS fs
            FROM (SELECT * FROM aerr WHERE error = '')))""")
_wire = wire("id", "sev", "cls", "descr", "n", "snippet", "pct", "cwe", "fixed", "why", "CASE WHEN automated THEN 'true' ELSE 'false' END")
block("aparsed", f"""
SELECT scan_id, file_ord, file_path, agent_ord, agent, available, error, latency_ms,
  coalesce(string_agg({_wire}, {NL} ORDER BY i) FILTER (i IS NOT NULL), '') AS findings,
  count(i) AS n_findings, coalesce(max(pct), 0) AS max_pct
FROM aerr LEFT JOIN afs USING (scan_id, file_ord, agent_ord) GROUP BY ALL""")


def winners(attempts: str) -> str:
    return f"""
SELECT scan_id, file_ord, max_by(file_path, agent_ord) AS file_path,
  min(agent_ord) FILTER (available AND error = '' AND (n_findings = 0 OR max_pct >= 75 OR agent_ord = last_ord)) AS win
FROM (SELECT *, max(agent_ord) OVER (PARTITION BY scan_id, file_ord) AS last_ord FROM {attempts})
GROUP BY scan_id, file_ord"""


block("awin", winners("aparsed"))
block("aall", f"""
SELECT scan_id, file_ord, file_path, agent_ord, agent, available, error, n_findings, max_pct FROM aparsed
UNION ALL SELECT scan_id, file_ord, file_path, 99, {lit(REGEX_AGENT)}, true, '', n_findings, max_pct FROM abuiltin""")
block("awinall", winners("aall"))
block("awire", f"""
SELECT scan_id, file_ord, agent_ord, i, id, sev, cls, descr, n, snippet, pct, cwe, fixed, why, automated FROM afs
UNION ALL SELECT scan_id, file_ord, 99, row_number() OVER (PARTITION BY scan_id, file_ord ORDER BY n), id, sev, cls,
  descr, n, snippet, pct, cwe, '', descr || ' — manual remediation required', false FROM ahits""")
block("afindings", f"""
SELECT w.scan_id, 2 AS phase, w.file_ord, 0 AS hunk_ord, i AS line_ord, 0 AS rule_ord, cls AS rule_id,
  w.file_path AS path, n AS line, descr AS message, {sev_rank('sev')} AS severity, snippet AS content,
  a.agent AS source, pct AS confidence_pct, id AS llm_id, cls AS vuln_class, cwe,
  (automated AND {trim('fixed')} <> '' AND a.agent <> {lit(REGEX_AGENT)}) AS auto_fixable, fixed, why
FROM awinall w JOIN awire f ON f.scan_id = w.scan_id AND f.file_ord = w.file_ord AND f.agent_ord = w.win
JOIN aall a ON a.scan_id = w.scan_id AND a.file_ord = w.file_ord AND a.agent_ord = w.win""")

# --- Scanner ------------------------------------------------------------------------

_flat = "replace(path, '/', '_')"
_want = f"coalesce(nullif({path_ext('path')}, ''), '.txt')"
block("flats", f"""
SELECT scan_id, file_ord, path, CASE WHEN {path_ext(_flat)} = {_want} THEN {_flat} ELSE {_flat} || {_want} END AS flat
FROM kept_files""")
block("nadded", """
SELECT f.*, coalesce(c, 0) AS n_added FROM flats f
LEFT JOIN (SELECT scan_id, file_ord, count(*) AS c FROM adds GROUP BY ALL) USING (scan_id, file_ord)""")
block("sreports", f"""
SELECT scan_id, scan_id % 3 <> 0 AS available, CASE WHEN scan_id % 11 = 4 THEN 2 ELSE scan_id % 2 END AS exit_code,
       replace({corpus.SCANNER_REPORT}, '{corpus.REPEATED_CHECK}', '') AS report
FROM (SELECT scan_id, string_agg({corpus.SCANNER_RESULT}, ',' ORDER BY file_ord) AS results FROM nadded GROUP BY scan_id)""")
block("sstatus", """
SELECT *, CASE WHEN NOT available THEN 'unavailable' WHEN exit_code NOT IN (0, 1) THEN 'scanner_error'
  WHEN report = '' THEN 'ok' WHEN NOT json_valid(report) THEN 'scanner_error'
  WHEN json_type(report) NOT IN ('OBJECT', 'NULL') THEN 'scanner_error'
  WHEN coalesce(json_type(report, '$.results'), 'NULL') NOT IN ('ARRAY', 'NULL') THEN 'scanner_error'
  WHEN json_type(report, '$.results') = 'ARRAY' AND len(list_filter(json_extract(report, '$.results[*]'),
       lambda r: json_type(r, '$.check_id') <> 'VARCHAR')) > 0 THEN 'scanner_error' ELSE 'ok' END AS status
FROM sreports""")
block("sresults", """
SELECT scan_id, result_ord, r->>'$.check_id' AS check_id, r->>'$.path' AS path, (r->>'$.start.line')::BIGINT AS start_line,
  (r->>'$.start.col')::BIGINT AS start_col, (r->>'$.end.line')::BIGINT AS end_line, (r->>'$.end.col')::BIGINT AS end_col,
  r->>'$.extra.message' AS message, r->>'$.extra.severity' AS severity, r->>'$.extra.lines' AS lines
FROM (SELECT scan_id, unnest(rs) AS r, generate_subscripts(rs, 1) AS result_ord FROM (
  SELECT scan_id, CASE WHEN json_type(report, '$.results') = 'ARRAY' THEN json_extract(report, '$.results[*]') ELSE [] END AS rs
  FROM (SELECT * FROM sstatus WHERE status = 'ok' AND report <> '')))""")
block("slines", """
SELECT f.scan_id, f.flat, f.path, a.number AS orig_line,
       row_number() OVER (PARTITION BY a.scan_id, a.file_ord ORDER BY hunk_ord, line_ord) AS n
FROM adds a JOIN (SELECT *, max(file_ord) OVER (PARTITION BY scan_id, flat) AS keep FROM nadded WHERE n_added > 0) f
  ON f.scan_id = a.scan_id AND f.file_ord = a.file_ord AND f.file_ord = f.keep""")
block("sfindings", f"""
SELECT r.scan_id, 1 AS phase, 0 AS file_ord, 0 AS hunk_ord, r.result_ord AS line_ord, 0 AS rule_ord, check_id AS rule_id,
  coalesce(l.path, r.path) AS path, coalesce(orig_line, start_line) AS line, message, {sev_rank('severity')} AS severity,
  {trim('lines')} AS content, 'semgrep' AS source, start_col AS "column", end_line, end_col AS end_column
FROM sresults r
LEFT JOIN slines l ON l.scan_id = r.scan_id AND l.flat = regexp_extract(r.path, '([^/]*)$', 1) AND l.n = r.start_line
WHERE (r.scan_id, regexp_extract(r.path, '([^/]*)$', 1)) IN (SELECT (scan_id, flat) FROM slines)""")

# --- Gate ---------------------------------------------------------------------------

SHORT = (
    "scan_id, phase, file_ord, hunk_ord, line_ord, rule_ord, rule_id, path, line, message, severity, content, source"
)
block("p1", f"""
SELECT * FROM (SELECT {SHORT} FROM rule_hits WHERE scan_id NOT IN (SELECT scan_id FROM sstatus WHERE status = 'ok')
  UNION ALL SELECT {SHORT} FROM sfindings) WHERE scan_id NOT IN (SELECT scan_id FROM sexempt)""")
block("allf", f"""
SELECT * FROM p1 UNION ALL SELECT {SHORT} FROM afindings WHERE scan_id NOT IN (SELECT scan_id FROM sexempt)""")
block("livef", """
SELECT * FROM allf WHERE (scan_id, path, line) NOT IN (SELECT (scan_id, path, line) FROM suppressed)""")
block("finalf", f"""
SELECT {SHORT} FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, rule_id || ':' || content
  ORDER BY phase, file_ord, hunk_ord, line_ord, rule_ord) AS rn FROM livef) WHERE rn = 1""")
block("fcounts", """
SELECT scan_id, count(*) FILTER (severity = 0) AS n_info, count(*) FILTER (severity = 1) AS n_warning,
  count(*) FILTER (severity = 2) AS n_error, count(*) FILTER (severity = 3) AS n_critical, count(*) AS n_findings
FROM finalf GROUP BY scan_id""")
block("stokens", """
SELECT repo, scan_ts - INTERVAL 30 SECOND AS created_at,
  scan_ts - INTERVAL 30 SECOND + to_hours(scan_id % 3) AS expires_at
FROM diffs WHERE scan_id % 7 = 2""")
block("sbypassed", """
SELECT scan_id FROM (
  SELECT t.created_at, t.expires_at, s.scan_ts, s.scan_id,
         row_number() OVER (PARTITION BY t.repo, t.created_at ORDER BY s.scan_ts, s.scan_id) AS rn
  FROM diffs s ASOF JOIN stokens t ON s.repo = t.repo AND s.scan_ts >= t.created_at)
WHERE rn = 1 AND scan_ts <= expires_at""")
block("sconfig", "SELECT scan_id FROM diffs WHERE scan_id % 19 = 4")
block("sexempt", "SELECT scan_id FROM sbypassed UNION SELECT scan_id FROM sconfig")
block("verdicts", f"""
SELECT scan_id, status, CASE WHEN status IN ('config_error', 'error', 'blocked') THEN 1 ELSE 0 END AS exit_code,
  CASE WHEN status IN ('clean', 'blocked', 'passed_with_findings') THEN nf ELSE 0 END AS n_findings,
  CASE WHEN status IN ('clean', 'blocked', 'passed_with_findings') THEN nb ELSE 0 END AS n_blocking
FROM (SELECT d.scan_id, coalesce(c.n_findings, 0) AS nf, coalesce(n_error + n_critical, 0) AS nb,
  CASE WHEN d.scan_id IN (SELECT scan_id FROM sconfig) THEN 'config_error'
       WHEN d.scan_id IN (SELECT scan_id FROM sbypassed) THEN 'bypassed'
       WHEN d.scan_id IN (SELECT scan_id FROM bad_headers) THEN 'error'
       WHEN d.scan_id NOT IN (SELECT scan_id FROM file_paths) THEN 'empty'
       WHEN d.scan_id NOT IN (SELECT scan_id FROM kept_files) THEN 'all_filtered'
       WHEN coalesce(c.n_findings, 0) = 0 THEN 'clean'
       WHEN n_error + n_critical > 0 THEN 'blocked' ELSE 'passed_with_findings' END AS status
  FROM diffs d LEFT JOIN fcounts c USING (scan_id))""")


# The same gate where the reports of some scans never came.
_gate = ("p1", "allf", "livef", "finalf", "fcounts", "verdicts")
for _name in _gate:
    _sql = BLOCKS[_name].replace("WHERE status = 'ok'", "WHERE status = 'ok' AND scan_id % 6 <> 1")
    _sql = _sql.replace("FROM sfindings", "FROM sfindings WHERE scan_id % 6 <> 1")
    for _other in _gate:
        _sql = re.sub(rf"\b{_other}\b", f"late_{_other}", _sql)
    block(f"late_{_name}", _sql)

_body = (
    "'{\"model\":\"gemini-2.0-flash\",\"messages\":[{\"role\":\"system\",\"content\":' || to_json("
    + lit(SYSTEM_PROMPT) + ")::VARCHAR || '},{\"role\":\"user\",\"content\":' || to_json(m)::VARCHAR || '}],\"temperature\":0.1}'"
)
for _ch, _code in (("<", "003c"), (">", "003e"), ("&", "0026")):
    _body = f"replace({_body}, '{_ch}', '\\u{_code}')"

_rule_rows = [
    (RULES_VERSION, "line", i, r.rule_id, r.pattern, r.message, r.severity, ",".join(r.file_exts) or None, "", 0)
    for i, r in enumerate(LINE_RULES, 1)
] + [
    (RULES_VERSION, "agent", i, r.vuln_class, r.pattern, r.description, r.severity, None, r.cwe, round(r.confidence * 100))
    for i, r in enumerate(AGENT_RULES, 1)
]
_rule_values = ", ".join(
    "(" + ", ".join("NULL" if v is None else lit(v) if isinstance(v, str) else str(v) for v in row) + ")"
    for row in _rule_rows
)

QUERIES = {
    "agent_requests": "SELECT * FROM areq",
    "agent_messages": f"""
SELECT scan_id, file_ord, m AS user_message, {_body} AS body FROM (SELECT *,
  'Analyze this diff for security vulnerabilities:' || {NL} || 'Language: ' || language || {NL} || 'File: ' || file_path
  || {NL} || {NL} || '```diff' || {NL} || added_lines || {NL} || '```' || {NL} || {NL} || 'Added lines: ' || added_count AS m
  FROM areq)""",
    "regex_agent": f"SELECT scan_id, file_ord, file_path, {lit(REGEX_AGENT)} AS agent, findings FROM abuiltin",
    "response_status": "SELECT scan_id, file_ord, agent_ord, provider, http_status, status_error FROM astatus",
    "parse_responses": """
SELECT scan_id, file_ord, agent_ord, agent, available, error, findings, n_findings FROM aparsed""",
    "resolve_chain": """
SELECT w.scan_id, w.file_ord, win IS NULL AS exhausted, agent AS agent_used, latency_ms, findings
FROM awin w LEFT JOIN aparsed a ON a.scan_id = w.scan_id AND a.file_ord = w.file_ord AND a.agent_ord = w.win""",
    "phase2_cutoff": """
SELECT w.scan_id, w.file_ord, agent AS agent_used
FROM (SELECT *, bool_or(win IS NULL) OVER (PARTITION BY scan_id ORDER BY file_ord) AS cut FROM awin) w
JOIN aparsed a ON a.scan_id = w.scan_id AND a.file_ord = w.file_ord AND a.agent_ord = w.win WHERE NOT cut""",
    "agent_findings": """
SELECT scan_id, file_ord, line_ord, rule_id, path, line, message, severity, content, source, confidence_pct, llm_id,
  vuln_class, cwe, auto_fixable, CASE WHEN auto_fixable THEN fixed ELSE '' END AS fixed_line,
  CASE WHEN auto_fixable THEN why ELSE '' END AS fix_explain FROM afindings""",
    "default_chain": "SELECT * FROM chains",
    "scanner_report": """
SELECT scan_id, status, result_ord, check_id, path, start_line, start_col, end_line, end_col, message, severity, lines
FROM sstatus LEFT JOIN sresults USING (scan_id)""",
    "scanner_line_map": "SELECT scan_id, flat, n, path, orig_line FROM slines",
    "scanner_remap": "SELECT * FROM sfindings",
    "phase1_source": "SELECT * FROM p1",
    "union_findings": "SELECT * FROM allf",
    "filter_suppressed": "SELECT * FROM livef",
    "dedup_findings": "SELECT * FROM finalf",
    "severity_counts": "SELECT * FROM fcounts",
    "scan_verdict": "SELECT * FROM verdicts",
    "scan_listing": f"""
SELECT scan_id, phase, file_ord, hunk_ord, line_ord, rule_ord,
  '[' || {sev_name('severity')} || '] ' || path || ':' || line || ' — ' || rule_id || ' — ' || message AS text FROM finalf
UNION ALL SELECT scan_id, 9, 0, 0, 0, 0, n_findings || ' finding(s)'
  || CASE WHEN n_critical > 0 THEN ' · ' || n_critical || ' critical' ELSE '' END
  || CASE WHEN n_error > 0 THEN ' · ' || n_error || ' error' ELSE '' END
  || CASE WHEN n_warning > 0 THEN ' · ' || n_warning || ' warning' ELSE '' END FROM fcounts""",
    "ignore_rules": """
SELECT * FROM finalf WHERE NOT CASE length(rule_id) % 4
  WHEN 0 THEN regexp_matches(path, '^src/src0/.*$') WHEN 1 THEN regexp_matches(path, '^src/[^/]*/d[^/]\\.py$')
  WHEN 2 THEN regexp_matches(path, '^.*\\.go$') ELSE regexp_matches(path, '^none/[^/]*$') END""",
    "findings_sink": """
SELECT d.repo, '{"scan_id":' || h.scan_id || ',"rule_id":"' || rule_id || '","path":"' || path || '","line":' || line
  || ',"column":0,"end_line":0,"end_column":0,"message":' || to_json(message)::VARCHAR || ',"severity":' || severity
  || ',"content":' || to_json(content)::VARCHAR || ',"source":"fallback","confidence":0.0,"patch":"","llm_id":"",'
  || '"vuln_class":"","cwe":"","auto_fixable":false,"fixed_line":"","fix_explain":"","latency_ms":0}' AS json
FROM rule_hits h JOIN diffs d ON d.scan_id = h.scan_id""",
    "rule_catalogue": f"""
SELECT r.*, coalesce(n, 0) AS n_findings
FROM (VALUES {_rule_values}) r(version, rule_set, rule_ord, rule_id, pattern, message, severity, file_exts, cwe, confidence_pct)
LEFT JOIN (SELECT rule_ord, count(*) AS n FROM rule_hits GROUP BY 1) c ON r.rule_set = 'line' AND r.rule_ord = c.rule_ord""",
}
