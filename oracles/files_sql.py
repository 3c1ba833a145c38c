"""Oracle blocks: related files, patches, review."""

from __future__ import annotations

import corpus
from corpus import EXTENSIONS
from hunkledger.catalogue import DECLARATION_MARKS, IMPORT_MARKS, SIBLING_WORDS

from .core import array, block, lit
from .text import path_ext, sev_name, trim

NL = "chr(10)"
_own = f"array_to_string(list_transform(list_filter(ls, lambda l: l[1] <> '-'), lambda l: substr(l, 2)), {NL}) || {NL}"
block("rdocs", f"""
SELECT l.doc_id, l.scan_id, l.path, l.ls, d.text, 'src/' || source AS dir, {array(EXTENSIONS)}[l.doc_id % 8 + 1] AS ext
FROM doc_lines l JOIN documents d USING (doc_id)""")
block("rfiles", "SELECT scan_id, path, strlen(content) AS size, is_dir, content FROM ("
      + f"SELECT scan_id, doc_id, path, {_own} AS content, false AS is_dir FROM rdocs "
      + " ".join(f"UNION ALL SELECT scan_id, doc_id, {p}, {c}, {str(d).lower()} FROM rdocs" for p, c, d in corpus.NEIGHBOURS)
      + ") QUALIFY row_number() OVER (PARTITION BY scan_id, path ORDER BY doc_id, content, is_dir) = 1")

_marks = "CASE ext " + " ".join(f"WHEN {lit(k)} THEN {array(v)}" for k, v in IMPORT_MARKS.items()) + " END"
_decls = "CASE ext " + " ".join(f"WHEN {lit(k)} THEN {array(v)}" for k, v in DECLARATION_MARKS.items()) + " END"


def dir_of(p: str) -> str:
    """Folder of a path without '.', '..' or empty parts, as the corpus' paths are."""
    return f"coalesce(nullif(regexp_extract({p}, '^(.*)/[^/]*$', 1), ''), '.')"


_clean = (
    "list_reduce(string_split(full_path, '/'), lambda acc, x: CASE WHEN x IN ('', '.') THEN acc "
    "WHEN x = '..' THEN CASE WHEN acc = '' THEN '..' WHEN acc = '..' OR ends_with(acc, '/..') THEN acc || '/..' "
    "ELSE regexp_replace(acc, '/?[^/]+$', '') END WHEN acc = '' THEN x ELSE acc || '/' || x END, '')"
)
block("imarks", f"""
SELECT a.*, m.mark_ord FROM (SELECT *, unnest({_marks}) AS mark, generate_subscripts({_marks}, 1) - 1 AS mark_ord
  FROM (SELECT *, {path_ext('path')} AS ext FROM adds)) m JOIN adds a USING (scan_id, file_ord, hunk_ord, line_ord)
WHERE contains(m.content, mark)""")
block("imods", """
SELECT scan_id, file_ord, hunk_ord, line_ord, mark_ord, path, quote_ord, part_ord, module FROM (
  SELECT *, 0 AS quote_ord, unnest(string_split(content, '"')) AS module, generate_subscripts(string_split(content, '"'), 1) - 1 AS part_ord FROM imarks
  UNION ALL
  SELECT *, 1, unnest(string_split(content, '''')), generate_subscripts(string_split(content, ''''), 1) - 1 FROM imarks)
WHERE part_ord % 2 = 1 AND (contains(module, '.') OR NOT contains(module, '/'))""")
block("icands", f"""
SELECT scan_id, file_ord, hunk_ord, line_ord, mark_ord, quote_ord, part_ord, importer, ext,
  CASE WHEN {path_ext('target')} = '' THEN target || ext ELSE target END AS path
FROM (SELECT *, coalesce(nullif({_clean}, ''), '.') AS target FROM (
  SELECT *, path AS importer, {path_ext('path')} AS ext, {dir_of('path')} || '/' || module AS full_path FROM imods))""")
block("iexist", "SELECT c.* FROM icands c SEMI JOIN rfiles r ON c.scan_id = r.scan_id AND c.path = r.path")
_word = "CASE " + " ".join(
    f"WHEN starts_with(regexp_extract(path, '([^/]*)$', 1), {lit(w)}) THEN {i}" for i, w in enumerate(SIBLING_WORDS)
) + " END"
block("sibs", f"""
SELECT r.scan_id, f.file_ord, {_word.replace('path', 'r.path')} AS word_ord, r.path
FROM rfiles r JOIN (SELECT scan_id, {dir_of('path')} AS dir, min(file_ord) AS file_ord FROM kept_files
  WHERE {path_ext('path')} IN ({', '.join(map(lit, IMPORT_MARKS))}) GROUP BY ALL) f
  ON r.scan_id = f.scan_id AND {dir_of('r.path')} = f.dir
WHERE {_word.replace('path', 'r.path')} IS NOT NULL""")


def signature(table: str, keep: str) -> str:
    """Signature text of ``table``'s rows by their ``ext`` and ``content``."""
    t = trim("lines[i]")
    return f"""
SELECT {keep}, array_to_string(CASE WHEN len(sel) > 0 THEN flatten(list_transform(sel, lambda i: list_concat(lines[i:i+2], [''])))
    ELSE lines END[1:50], {NL}) AS content
FROM (SELECT *, list_filter(range(1, len(lines) + 1), lambda i: {t} <> '' AND NOT starts_with({t}, '//') AND NOT starts_with({t}, '#')
        AND len(list_filter(marks, lambda m: contains(lines[i], m))) > 0) AS sel
      FROM (SELECT *, string_split(content, {NL}) AS lines, coalesce({_decls}, []::VARCHAR[]) AS marks FROM {table}))"""


block("small", "SELECT *, " + path_ext("path") + " AS ext FROM rfiles WHERE NOT is_dir AND size <= 8192")
block("offers", """
SELECT scan_id, path, [file_ord, 0, hunk_ord, line_ord, mark_ord, quote_ord, part_ord] AS k, 'imported by ' || importer AS reason, ext FROM iexist
UNION ALL SELECT scan_id, path, [file_ord, 1, word_ord, 0, 0, 0, 0], 'security-relevant sibling file', """ + path_ext("path") + " FROM sibs")
block("firsts", """
SELECT * FROM offers o WHERE (scan_id, path) IN (SELECT (scan_id, path) FROM small)
  AND (scan_id, path) NOT IN (SELECT (scan_id, path) FROM kept_files)
QUALIFY row_number() OVER (PARTITION BY scan_id, path ORDER BY k) = 1""")
block("chosen", """
SELECT f.scan_id, f.path, f.reason, f.ext, s.content, slot
FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY k, path) AS slot FROM firsts) f
JOIN small s ON f.scan_id = s.scan_id AND f.path = s.path WHERE slot <= 3""")

# --- Patches ------------------------------------------------------------------------

_hits = "scan_id, file_ord, hunk_ord, line_ord, rule_ord, rule_id, path, line, message, severity, content, source"
block("rfind", f"""
SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY phase, file_ord, hunk_ord, line_ord, rule_ord) AS finding_ord
FROM (SELECT 1 AS phase, {_hits} FROM rule_hits UNION ALL SELECT 2, {_hits} FROM rule_hits)""")
block("rlines", f"""
SELECT scan_id, path, ends_with(content, {NL}) AS nl, unnest(ls) AS have, generate_subscripts(ls, 1) AS n, len(ls) AS n_lines
FROM (SELECT *, string_split(regexp_replace(content, '\\n$', ''), {NL}) AS ls FROM rfiles WHERE NOT is_dir)""")
block("kinds", """
SELECT *, CASE WHEN finding_ord % 5 = 0 OR finding_ord % 11 = 2 THEN 'none' WHEN finding_ord % 7 = 1 THEN 'insert'
  WHEN finding_ord % 13 = 3 THEN 'wrong' ELSE 'replace' END AS kind FROM rfind""")
block("checked", """
SELECT k.*, coalesce(CASE kind WHEN 'replace' THEN l.have = k.content WHEN 'insert' THEN l.have IS NOT NULL ELSE false END, false) AS applies
FROM kinds k LEFT JOIN rlines l ON k.scan_id = l.scan_id AND k.path = l.path AND k.line = l.n""")
block("acts", """
SELECT *, kind = 'insert' OR row_number() OVER (PARTITION BY scan_id, path, line, kind ORDER BY finding_ord) = 1 AS applied
FROM checked WHERE applies AND finding_ord % 4 NOT IN (0, 3)""")
block("newlines", """
SELECT scan_id, path, n AS at_line, 0 AS finding_ord, 0 AS i, have AS t FROM rlines l
WHERE (scan_id, path) IN (SELECT (scan_id, path) FROM acts WHERE applied)
  AND (scan_id, path, n) NOT IN (SELECT (scan_id, path, line) FROM acts WHERE applied AND kind = 'replace')
UNION ALL SELECT scan_id, path, line, finding_ord, 1, CASE kind WHEN 'insert' THEN 'inserted ' ELSE 'fixed ' END || finding_ord FROM acts WHERE applied
UNION ALL SELECT scan_id, path, line, finding_ord, 2, 'more' FROM acts WHERE applied AND kind = 'replace'""")
block("reviewed", f"""
SELECT r.scan_id, r.finding_ord, CASE WHEN a.applied THEN 'apply' WHEN NOT a.applied THEN 'apply_failed' ELSE 'skip' END AS action,
  r.rule_id, r.path, r.line, {sev_name('r.severity')} AS severity, r.source, r.message
FROM rfind r LEFT JOIN acts a ON r.scan_id = a.scan_id AND r.finding_ord = a.finding_ord
WHERE r.scan_id IN (SELECT scan_id FROM rfind WHERE finding_ord % 5 <> 0)""")

QUERIES = {
    "import_candidates": "SELECT * FROM iexist",
    "sibling_candidates": "SELECT * FROM sibs",
    "signatures": signature("small", "scan_id, path"),
    "related_files": signature("chosen", "scan_id, slot, path, reason"),
    "patch_check": "SELECT scan_id, finding_ord, applies FROM checked",
    "patch_apply": f"""
SELECT n.scan_id, n.path, string_agg(t, {NL} ORDER BY at_line, finding_ord, i) || {NL} AS content
FROM newlines n GROUP BY ALL""",
    "review_outcomes": "SELECT * FROM reviewed",
    "review_summary": """
SELECT scan_id, count(*) FILTER (action <> 'skip') AS n_chosen, count(*) FILTER (action = 'apply') AS n_applied,
  count(*) FILTER (action = 'skip') AS n_skipped FROM reviewed GROUP BY scan_id""",
}
