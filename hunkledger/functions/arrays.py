"""Small helpers on array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def drop_first(parts: Column) -> Column:
    # The length is a constant: one taken from ``parts`` would make the array a second time.
    return F.slice(parts, F.lit(2), F.lit(1 << 30))


def held(value: Column) -> Column:
    """``value`` as a generator output.

    Catalyst moves filters below a projection by copying the projected expression into
    them, once per use.  It does not move them below a generator, so an expensive value
    produced by one is computed once per row.
    """
    return F.explode_outer(F.array(value))
