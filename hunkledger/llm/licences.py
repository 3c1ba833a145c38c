"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard
parser evaluates the licence expression behind a tag.

Words are runs of digits, letters a to z (A to Z lowered) and anything outside ASCII.  Phrases match
whole consecutive words.  A tag's expression is read from the raw text to the end of its line.
``labels`` holds every licence that a tag allows, ``required`` those that no way around a tag avoids: both
of ``MIT AND GPL``, none of ``MIT OR GPL``.

NULL text counts as empty: 0 words, no places, empty labels and ``required``, score 0.  Repeated rows each get a
result; extra columns pass through, one named like a result column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Phrases of the method's own, their labels and how surely they mean a licence.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "gnu general public license version 2": ("gpl-2.0", 0.95),
    "gnu general public license version 3": ("gpl-3.0", 0.95),
    "apache license version 2 0": ("apache-2.0", 0.95),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "bsd license": ("bsd", 0.8),
    "isc license": ("isc", 0.8),
    "boost software license": ("bsl", 0.9),
    "creative commons": ("cc", 0.6),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc by nc sa": ("cc-by-nc-sa", 0.9),
    "cc by nc nd": ("cc-by-nc-nd", 0.9),
    "cc0": ("cc0", 0.8),
    "public domain": ("public-domain", 0.5),
    "all rights reserved": ("proprietary", 0.5),
}
#: Words that announce a licence; one right before a phrase makes it surer.
OPENERS = ("licensed under", "released under", "distributed under", "under the terms of", "available under")
TAG = "spdx license identifier"
#: Base labels count so much without an opener.
BASE_SCORE = 0.7

#: Every byte that is no word byte becomes a space, A to Z become a to z.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_TAG_LINE = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, *OPENERS, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def postfix(expression: str) -> list[str]:
    """Shunting-yard: the longest well-formed beginning of a licence expression, operators last.
    ``with`` binds closest, then ``and``, then ``or``; equal ones from the left."""
    out: list[str] = []
    stack: list[str] = []
    value_next = True
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if value_next:
            if token == "(":
                stack.append(token)
                continue
            if token == ")" or word in _RANK:
                break
            out.append(word)
            value_next = False
        elif word in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            value_next = True
        elif token == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            break
    if value_next:
        while stack and stack[-1] == "(":
            stack.pop()
        if stack:
            stack.pop()  # an operator without its right side
    out += [s for s in reversed(stack) if s != "("]
    return out


def merged(one: set[str], other: set[str]) -> set[str]:
    """The union, put into the larger of both sets."""
    small, large = sorted((one, other), key=len)
    large |= small
    return large


def evaluate(expression: str) -> tuple[set[str], set[str]]:
    """(required, allowed): the licences that every way to satisfy the expression needs, and those
    that some way uses.

    ``and`` needs what either side needs, ``or`` only what both need; ``with`` ties an exception, a single
    name, to each licence on its left that has none yet, and counts as ``and`` elsewhere.  Each operand
    is put into a larger set or tied once, so the work grows with the expression, not with its ways.
    """
    stack: list[tuple[set[str], set[str], set[str]]] = []  # required, allowed, allowed without exception
    for token in postfix(expression):
        if token not in _RANK:
            stack.append(({token}, {token}, {token}))
            continue
        if len(stack) < 2:
            continue
        (right, may, bare), (needs, can, free) = stack.pop(), stack.pop()
        if token == "with" and free and len(may) == len(bare) == 1:
            exception = next(iter(may))
            for name in free:
                tied = f"{name} with {exception}"
                can.discard(name)
                can.add(tied)
                if name in needs:
                    needs.discard(name)
                    needs.add(tied)
            stack.append((needs, can, set()))
            continue
        if token == "or":
            small, large = sorted((needs, right), key=len)
            both = {name for name in small if name in large}
        else:
            both = merged(needs, right)
        stack.append((both, merged(can, may), merged(free, bare)))
    return stack[-1][:2] if stack else (set(), set())


def scan(text: str | None) -> tuple:
    """The values of ``COLUMNS`` for one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    line = " " + b" ".join(words).decode("latin-1") + " "
    starts: list[int] = []
    base: set[str] = set()
    found: dict[str, float] = {}
    openers: list[int] = []
    tagged = False
    required: set[str] = set()
    hits = sorted((end - len(phrase) - 1, phrase) for end, phrase in automaton().iter(line))
    seen, upto = 0, 0
    for at, phrase in hits:
        seen += line.count(" ", upto, at)
        upto = at
        if phrase in OPENERS:
            openers.append(seen + phrase.count(" ") + 1)
            continue
        if phrase == TAG:
            tagged = True
            continue
        announced = bool(openers) and 0 <= seen - openers[-1] <= 1
        if phrase in BASE:
            label, sure = BASE[phrase], BASE_SCORE
            base.add(label)
            starts.append(seen)
        else:
            label, sure = NOTICES[phrase]
        found[label] = max(found.get(label, 0.0), 1 - (1 - sure) / 2 if announced else sure)
    if tagged:
        for match in _TAG_LINE.finditer(text):
            needed, allowed = evaluate(match.group(1))
            found.update(dict.fromkeys(allowed, 1.0))
            required |= needed
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(found)), max(found.values(), default=0.0),
        ",".join(sorted(required)),
    )


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "required"]


def _scan_udf():
    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, required string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = pd.DataFrame([scan(t if isinstance(t, str) else None) for t in texts], columns=COLUMNS)
            yield rows.astype({"first_word": "Int64", "last_word": "Int64"})

    return run


def scan_licences(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns of ``COLUMNS``.  Labels with a comma cannot occur; both lists are sorted."""
    return docs.drop(*COLUMNS).withColumn("__r", _scan_udf()(F.col(text))).select("*", "__r.*").drop("__r")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licences(docs).select("doc_id", *COLUMNS)
