"""Literal pre-filters for regular expressions.

Most lines match no rule.  A rule names plain texts of which every match holds at least
one; a substring test on them is far cheaper than the regular expression, which then runs
on few lines.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import to_java


#: In a need: 's' or the one other character that folds to it and that lower-casing leaves alone.
EITHER_S = "\u017f"


def spellings(need: str) -> list[str]:
    """The texts that a need stands for: each ``EITHER_S`` in it is an 's' or U+017F itself."""
    return ["".join(c) for c in product(*[("s", EITHER_S) if ch == EITHER_S else ch for ch in need])]


def plain_part(need: str) -> str:
    """The longest part of a need that has one spelling only."""
    return max(need.split(EITHER_S), key=len)


def matches(pattern: str, text: Column, lowered: Column, needs: Sequence[str] = ()) -> Column:
    """Does the RE2 ``pattern`` match ``text``; ``lowered`` is ``text`` in lower case.

    ``needs`` are looked up in the lower-cased text if the pattern ignores case.  Case folding
    lets U+017F match 's', which lower-casing leaves as it is, so a need of such a pattern must
    avoid that letter.
    """
    found = F.rlike(text, F.lit(to_java(pattern)))
    folds = pattern.startswith("(?i)")
    where = lowered if folds else text
    test = None
    for t in (spelt for need in needs for spelt in (spellings(need) if folds else [need])):
        one = F.contains(where, F.lit(t))
        test = one if test is None else test | one
    return found if test is None else test & found
