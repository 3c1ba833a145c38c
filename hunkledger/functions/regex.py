"""Translate RE2-dialect patterns to the java.util.regex dialect Spark runs.

The rule catalogues are written for RE2.  Differences that change matches:
``\\b`` and ``\\s`` are wider in Java, ``.`` and ``$`` know more line ends, and
RE2's case folding lets ASCII letters meet U+017F and U+212A.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"\t\n\f\r "
_FOLDED_WORD = r"\w\u017f\u212a"
_BOUNDARY = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
_NO_BOUNDARY = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"


def to_java(pattern: str) -> str:
    """Java pattern with the same matches as the RE2 ``pattern``."""
    fold = pattern.startswith("(?i)")
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            token = pattern[i : i + 2]
            out.append(_escape(token, in_class, fold))
            i += 2
            continue
        if in_class:
            # Java reads '[' and '&&' inside a class as set syntax, RE2 as plain characters.
            out.append("\\" + ch if ch in "[&" else ch)
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
            out.append(ch)
        elif ch == "$":
            out.append(r"\z")
        else:
            out.append(ch)
        i += 1
    return "(?du)" + "".join(out)


def _escape(token: str, in_class: bool, fold: bool) -> str:
    if token == r"\s":
        return _SPACE if in_class else f"[{_SPACE}]"
    if token == r"\S":
        return f"[^{_SPACE}]"
    if token == r"\w" and fold:
        return _FOLDED_WORD if in_class else f"[{_FOLDED_WORD}]"
    if token == r"\b" and not in_class:
        return _BOUNDARY
    if token == r"\B" and not in_class:
        return _NO_BOUNDARY
    return token


def java_pattern(pattern: Column) -> Column:
    """``to_java`` for patterns in a column: a fold over the pattern's tokens."""
    fold = F.startswith(pattern, F.lit("(?i)"))

    def chosen(token: Column, cases: dict[str, Column]) -> Column:
        out = token
        for text, value in cases.items():
            out = F.when(token == F.lit(text), value).otherwise(out)
        return out

    def step(state: Column, token: Column) -> Column:
        inside = state["inside"]
        word = F.when(fold, F.when(inside, F.lit(_FOLDED_WORD)).otherwise(F.lit(f"[{_FOLDED_WORD}]"))).otherwise(token)
        escape = chosen(token, {
            r"\s": F.when(inside, F.lit(_SPACE)).otherwise(F.lit(f"[{_SPACE}]")),
            r"\S": F.lit(f"[^{_SPACE}]"),
            r"\w": word,
            r"\b": F.when(inside, token).otherwise(F.lit(_BOUNDARY)),
            r"\B": F.when(inside, token).otherwise(F.lit(_NO_BOUNDARY)),
        })
        member = F.when(token.isin("[", "&"), F.concat(F.lit("\\"), token)).otherwise(token)
        plain = F.when(token == "$", F.lit(r"\z")).otherwise(token)
        escaped = F.length(token) == 2
        return F.struct(
            F.array_append(state["out"], F.when(escaped, escape).when(inside, member).otherwise(plain)).alias("out"),
            F.when(escaped, inside).when(inside, token != "]").otherwise(token == "[").alias("inside"),
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("inside"))
    tokens = F.regexp_extract_all(pattern, F.lit(r"(?s)\\.|."), F.lit(0))
    return F.concat(F.lit("(?du)"), F.aggregate(tokens, start, step, lambda s: F.array_join(s["out"], "")))


def glob_pattern(glob: Column) -> Column:
    """Anchored pattern for a file glob: ``**`` crosses ``/``, ``*`` and ``?`` do not."""
    escaped = F.regexp_replace(glob, r"([\\.+^$|(){}\[\]])", r"\\$1")
    spanned = F.replace(escaped, F.lit("**"), F.lit("\x00"))
    starred = F.replace(spanned, F.lit("*"), F.lit("[^/]*"))
    marked = F.replace(starred, F.lit("?"), F.lit("[^/]"))
    body = F.replace(marked, F.lit("\x00"), F.lit(".*"))
    return F.concat(F.lit(r"(?s)\A"), body, F.lit(r"\z"))
