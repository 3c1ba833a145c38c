"""Oracle blocks: corpus, diff parsing, Phase 1, post-processing."""

from __future__ import annotations

from corpus import BLANK_SCANS, EXTENSIONS, IMPORT_LINES, TEMPLATES
from hunkledger.catalogue import BLOCKED_EXTENSIONS, LINE_RULES, SUPPRESS_MARKER

from .core import array, block, lit
from .text import last_dot_ext, path_ext, sev_rank, trim

block("doc_lines", f"""
SELECT doc_id, doc_id // 5 AS scan_id,
       'src/' || source || '/d' || doc_id || {array(EXTENSIONS)}[doc_id % 8 + 1] AS path,
       list_transform(
         list_concat(string_split(text, chr(10)),
                     [{array(TEMPLATES)}[(doc_id + doc_id // 16) % 16 + 1],
                      {array(IMPORT_LINES)}[doc_id % 3 + 1], 'tail']),
         lambda l, i: CASE WHEN (i - 1) % 7 = 3 THEN ' ' WHEN (i - 1) % 11 = 5 THEN '-' ELSE '+' END || l
       ) AS ls
FROM documents""")

block("sections", """
SELECT scan_id, doc_id,
  'diff --git a/' || path || ' b/' || path || chr(10) || '--- a/' || path || chr(10)
  || CASE WHEN doc_id % 23 = 9 THEN '+++ /dev/null' ELSE '+++ b/' || path END
  || chr(10) || '@@ -1,' || len(list_filter(ls, lambda l: l[1] <> '+'))
  || ' +1,' || len(list_filter(ls, lambda l: l[1] <> '-')) || ' @@' || chr(10)
  || array_to_string(ls, chr(10)) || chr(10)
  || CASE WHEN doc_id % 19 = 4 THEN array_to_string(['@@ -500 +500,2 @@ fn', '+second',
       '+++ b/src/moved' || doc_id || '.py', '--- dropped', ' ctx',
       '\\ No newline at end of file', '+os.system(cmd)', ''], chr(10)) ELSE '' END AS section
FROM doc_lines""")

block("diffs", f"""
SELECT scan_id, 'repo-' || scan_id % 10 AS repo,
       TIMESTAMP '2024-01-01' + to_minutes(scan_id % {BLANK_SCANS}) AS scan_ts, raw
FROM (
  SELECT scan_id,
    CASE WHEN scan_id % 17 = 3 THEN array_to_string(['@@ -1 +1 @@', '+orphan one', '@@ -7,2 +9,2 @@',
      '+orphan eval(x)', ' ctx', ''], chr(10)) ELSE '' END
    || string_agg(section, '' ORDER BY doc_id)
    || CASE WHEN scan_id % 41 = 7 THEN array_to_string(['@@ -x +1 @@', '+lost', ''], chr(10)) ELSE '' END AS raw
  FROM sections GROUP BY scan_id
  UNION ALL
  SELECT item_id + {BLANK_SCANS}, CASE WHEN item_id % 2 = 0 THEN ' ' || chr(10) || chr(9) ELSE text END
  FROM benchmark
)""")

HEADER = r"^@@ -?([+-]?\d+)(?:,([+-]?\d+))? \+?([+-]?\d+)(?:,([+-]?\d+))?(?: @@(?:.|\n)*)?$"

block("raw_lines", """
SELECT scan_id, unnest(string_split(raw, chr(10))) AS l,
       generate_subscripts(string_split(raw, chr(10)), 1) AS pos
FROM diffs WHERE """ + trim("raw") + " <> ''")


def _num(g: int) -> str:
    return f"try_cast(coalesce(nullif(regexp_extract(l, '{HEADER}', {g}), ''), '1') AS BIGINT)"


block("bad_headers", f"""
SELECT scan_id, pos, l FROM raw_lines
WHERE starts_with(l, '@@ ') AND (NOT regexp_matches(l, '{HEADER}')
  OR {_num(1)} IS NULL OR {_num(2)} IS NULL OR {_num(3)} IS NULL OR {_num(4)} IS NULL)""")

block("classed", """
SELECT scan_id, pos, l,
  CASE WHEN starts_with(l, 'diff --git ') THEN 'file' WHEN starts_with(l, '+++ b/') THEN 'path'
       WHEN starts_with(l, '--- ') THEN 'skip' WHEN starts_with(l, '@@ ') THEN 'hunk'
       WHEN l[1] = '+' THEN 'add' WHEN l[1] = '-' THEN 'del' WHEN l[1] = ' ' THEN 'ctx'
       ELSE 'skip' END AS c
FROM raw_lines WHERE scan_id NOT IN (SELECT scan_id FROM bad_headers)""")

block("filed", """
SELECT *, count(*) FILTER (c = 'file') OVER w AS file_seq,
       count(*) FILTER (c = 'file') OVER (PARTITION BY scan_id) AS n_files,
       max(CASE WHEN c = 'hunk' THEN pos END) OVER w AS hunk_pos
FROM classed WINDOW w AS (PARTITION BY scan_id ORDER BY pos)""")

# A hunk line before the first file header counts only if its hunk is the last such one.
block("kept_lines", """
SELECT f.*, greatest(file_seq, 1) AS file_ord
FROM filed f LEFT JOIN (SELECT scan_id, max(pos) AS last_orphan FROM filed
                        WHERE file_seq = 0 AND c = 'hunk' GROUP BY scan_id) o USING (scan_id)
WHERE n_files > 0 AND (file_seq > 0 OR hunk_pos = last_orphan)""")

block("file_paths", """
SELECT scan_id, file_seq AS file_ord,
       coalesce(max_by(substr(l, 7), pos) FILTER (c = 'path'), '') AS path
FROM filed WHERE file_seq > 0 GROUP BY ALL""")

block("hunk_lines", """
SELECT scan_id, file_ord, pos, l, c,
       count(*) FILTER (c = 'hunk') OVER (PARTITION BY scan_id, file_ord ORDER BY pos) AS hunk_ord
FROM kept_lines""")

# file_seq = 0 lines of a surviving orphan hunk run on into the first file, so a file's
# hunk counter starts at the orphan.
block("hunk_heads", f"""
SELECT scan_id, file_ord, hunk_ord, {_num(1)} AS old_start, {_num(2)} AS old_count,
       {_num(3)} AS new_start, {_num(4)} AS new_count
FROM hunk_lines WHERE c = 'hunk'""")

block("dlines", """
SELECT scan_id, file_ord, path, hunk_ord,
  row_number() OVER w AS line_ord, c AS kind, substr(l, 2) AS content,
  CASE WHEN c = 'del' THEN 0 ELSE new_start + count(*) FILTER (c <> 'del') OVER w - 1 END AS number,
  CASE WHEN c = 'add' THEN 0 ELSE old_start + count(*) FILTER (c <> 'add') OVER w - 1 END AS old_number
FROM hunk_lines JOIN hunk_heads USING (scan_id, file_ord, hunk_ord) JOIN file_paths USING (scan_id, file_ord)
WHERE c IN ('add', 'del', 'ctx') AND hunk_ord > 0
WINDOW w AS (PARTITION BY scan_id, file_ord, hunk_ord ORDER BY pos ROWS UNBOUNDED PRECEDING)""")

block("kept_files", f"""
SELECT * FROM file_paths WHERE {path_ext('path')} NOT IN ({', '.join(map(lit, BLOCKED_EXTENSIONS))})""")

block("kept_dlines", """
SELECT d.* FROM dlines d SEMI JOIN kept_files k ON d.scan_id = k.scan_id AND d.file_ord = k.file_ord""")

block("adds", "SELECT * FROM kept_dlines WHERE kind = 'add'")

_rules = ",\n".join(
    f"({i}, {lit(r.rule_id)}, {lit(r.pattern)}, {lit(r.message)}, {lit(r.severity)}, "
    + (array(r.file_exts) if r.file_exts else "NULL::VARCHAR[]") + ")"
    for i, r in enumerate(LINE_RULES, 1)
)
block("line_rules", f"SELECT * FROM (VALUES {_rules}) t(rule_ord, rule_id, pattern, message, sev, exts)")

# The patterns are matched one by one as constants; joining on a pattern column would
# compile the pattern for every row.
_hits = " || ".join(
    "CASE WHEN "
    + (f"ext IN ({', '.join(map(lit, r.file_exts))}) AND " if r.file_exts else "")
    + f"regexp_matches(content, {lit(r.pattern)}) THEN [{i}] ELSE [] END"
    for i, r in enumerate(LINE_RULES, 1)
)
block("rule_hits", f"""
SELECT scan_id, 1 AS phase, file_ord, hunk_ord, line_ord, rule_ord, rule_id, path, number AS line,
       message, {sev_rank('sev')} AS severity, {trim('content')} AS content, 'fallback' AS source
FROM (SELECT *, unnest({_hits}) AS rule_ord FROM (SELECT *, {last_dot_ext('path')} AS ext FROM adds))
JOIN line_rules USING (rule_ord)""")

block("marks", f"""
SELECT *, contains(content, {lit(SUPPRESS_MARKER)}) AND kind = 'add' AS marked,
       lag(contains(content, {lit(SUPPRESS_MARKER)}) AND kind = 'add')
         OVER (PARTITION BY scan_id, file_ord, hunk_ord ORDER BY line_ord) AS after_mark
FROM kept_dlines""")
block("suppressed", """
SELECT DISTINCT scan_id, path, number AS line FROM marks
WHERE kind = 'add' AND (marked OR after_mark)""")

QUERIES = {
    "read_diffs": f"""
SELECT scan_id, repo, strftime(scan_ts, '%Y-%m-%d %H:%M:%S') AS scan_ts, {trim('raw')} = '' AS is_empty,
       length(raw) AS n_chars, md5(raw) AS raw_md5 FROM diffs""",
    "diff_files": "SELECT * FROM file_paths",
    "diff_hunks": "SELECT * FROM hunk_heads",
    "diff_lines": "SELECT * FROM dlines",
    "large_diff_files": "SELECT * FROM file_paths",
    "large_diff_hunks": "SELECT * FROM hunk_heads",
    "large_diff_lines": "SELECT * FROM dlines",
    "diff_errors": """
SELECT scan_id, min(pos) AS line_no, min_by(l, pos) AS header FROM bad_headers GROUP BY scan_id""",
    "large_diff_errors": """
SELECT scan_id, min(pos) AS line_no, min_by(l, pos) AS header FROM bad_headers GROUP BY scan_id""",
    "filter_blocked": "SELECT * FROM kept_files",
    "added_lines": """
SELECT scan_id, file_ord, path, hunk_ord, line_ord, content, number FROM adds""",
    "rule_scan": "SELECT * FROM rule_hits",
    "rule_scan_indexed": "SELECT * FROM rule_hits",
    "suppressed_lines": "SELECT * FROM suppressed",
}
