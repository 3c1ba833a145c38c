"""The diff parser against a plain loop over random and hand-written diffs."""

import random

from hunkledger.operators import diffs as D
from hunkledger.operators import filters, post

SCHEMA = "scan_id bigint, raw string"
I64 = 1 << 63


def header(line):
    import re

    r = r"([+-]?[0-9]+)(?:,([+-]?[0-9]+))?"
    m = re.fullmatch(rf"@@ -?{r} \+?{r}(?: @@.*)?", line, re.S)
    if not m:
        return None
    out = [int(x) if x is not None else 1 for x in m.groups()]
    return out if all(-I64 <= v < I64 for v in out) else None


def loop_parse(raw):
    """(files, error): files as [path, [(head, [(kind, text, number)])]]"""
    files, current, hunk, number = [], None, None, 0
    for i, line in enumerate(raw.split("\n")):
        if line.startswith("diff --git "):
            if current is not None:
                if hunk is not None:
                    current[1].append(hunk)
                    hunk = None
                files.append(current)
            current = ["", []]
        elif line.startswith("+++ b/"):
            if current is not None:
                current[0] = line[6:]
        elif line.startswith("--- "):
            pass
        elif line.startswith("@@ "):
            if current is not None and hunk is not None:
                current[1].append(hunk)
            head = header(line)
            if head is None:
                return [], (i + 1, line)
            hunk, number = (head, []), head[2]
        elif hunk is not None and line[:1] in ("+", "-", " ") and line:
            kind = {"+": "add", "-": "del", " ": "ctx"}[line[0]]
            hunk[1].append((kind, line[1:], 0 if kind == "del" else number))
            if kind != "del":
                number = (number + 1 + I64) % (2 * I64) - I64
    if current is not None:
        if hunk is not None:
            current[1].append(hunk)
        files.append(current)
    return files, None


PIECES = [
    "diff --git a/x b/x", "diff --git a/y.py b/y.py", "--- a/x", "--- ", "+++ b/x.go", "+++ b/d/y.py",
    "+++ /dev/null", '+++ "b/q"', "@@ -1 +1 @@", "@@ -1,3 +2,4 @@ fn @@ x", "@@ -9,0 +10,2 @@", "@@ -+5 ++7 @@",
    "+a", "+b scan-ignore", "-c", "-- d", " e", " ", "", "+", "-", "\\ No newline", "index 1..2", "+x\r", "+é z",
]
BAD = ["@@ -x +1 @@", "@@ -1", "@@ -1 +99999999999999999999 @@", "@@ -1,2,3 +1 @@", "@@  @@", "@@ -1 +1\r"]


def random_diffs(n, seed):
    rnd = random.Random(seed)
    for _ in range(n):
        lines = [rnd.choice(PIECES) for _ in range(rnd.randint(0, 25))]
        if rnd.random() < 0.1:
            lines.insert(rnd.randint(0, len(lines)), rnd.choice(BAD))
        yield "\n".join(lines)


EDGE = [
    "diff --git a b\n@@ -1 +9223372036854775807 @@\n+a\n+b\n c",
    "@@ -1 +1 @@\n+only an orphan",
    "   \n\t",
    "diff --git a b",
    "@@ -1 +1 @@\n+a\n@@ -5 +7 @@\n+b\n+++ b/lost\ndiff --git a b\n+++ /dev/null\n c\n@@ -1 +1 @@\n+d\n+++ b/found\n+e",
]


def test_parser_equals_loop(spark):
    raws = EDGE + list(random_diffs(2500, 7))
    df = spark.createDataFrame(list(enumerate(raws)), SCHEMA).cache()
    files, heads, lines, errors, facts, marked = [], [], [], [], [], set()
    for i, raw in enumerate(raws):
        parsed, error = ([], None) if raw.strip() == "" else loop_parse(raw)
        if error:
            errors.append((i, *error))
        facts.append((i, raw.strip() == "", error is not None, len(parsed)))
        for f, (path, hunks) in enumerate(parsed, 1):
            files.append((i, f, path))
            for h, (head, body) in enumerate(hunks, 1):
                heads.append((i, f, h, *head))
                for k, (kind, text, number) in enumerate(body, 1):
                    lines.append((i, f, path, h, k, kind, text, number))
                    if kind == "add" and "scan-ignore" in text:
                        marked.add((i, path, number))
                        if k < len(body) and body[k][0] == "add":
                            marked.add((i, path, body[k][2]))

    def got(frame):
        return sorted(tuple(r) for r in frame.collect())

    assert got(D.diff_files(df)) == sorted(files)
    assert got(D.diff_hunks(df)) == sorted(heads)
    assert got(D.diff_lines(df).drop("old_number")) == sorted(lines)
    assert got(D.diff_errors(df)) == sorted(errors)
    assert got(D.scan_files(df, ()).drop("n_kept")) == sorted(facts)
    files_added = D.with_added(D.file_sections(df))
    assert got(filters.added_lines(files_added)) == sorted(
        (i, f, p, h, k, t, n) for i, f, p, h, k, kind, t, n in lines if kind == "add"
    )
    assert got(post.suppressed_lines(files_added)) == sorted(marked)


def test_old_numbers(spark):
    raw = "diff --git a b\n+++ b/x\n@@ -10,3 +20,3 @@\n a\n-b\n+B\n c"
    rows = D.diff_lines(spark.createDataFrame([(1, raw)], SCHEMA)).collect()
    assert {(r.kind, r.content): (r.number, r.old_number) for r in rows} == {
        ("ctx", "a"): (20, 10), ("del", "b"): (0, 11), ("add", "B"): (21, 0), ("ctx", "c"): (22, 12),
    }


def test_parsing_never_shuffles(spark):
    df = spark.createDataFrame([(1, "diff --git a b")], SCHEMA)
    plan = D.diff_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_blocked_extensions(spark):
    paths = ["a.min.js", "X.PNG", "x.png", "a.lock/b", "go.sum", ".lock", ""]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = [r.path for r in filters.filter_blocked(df).collect()]
    assert kept == ["a.min.js", "X.PNG", "a.lock/b", ""]
