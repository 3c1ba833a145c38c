"""Ranks and as-of carries that never put one hot key into one task.

A window over a hot key sorts the whole key in one task.  These helpers cut the key
into bounded sub-groups, rank or carry inside each, and add what the earlier
sub-groups contribute from a small per-sub-group summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def add_rank(
    df: DataFrame, group: list[str], sub: list[str], order: list[str], name: str
) -> DataFrame:
    """Dense 1-based position inside ``group``, ordered by ``sub`` then ``order``.

    Rows are sorted inside (group, sub) only; the position of a sub-group comes from
    counts, so a group may be of any size as long as its sub-groups are bounded.
    """
    sizes = df.groupBy(*group, *sub).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(*sub).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *group, *sub, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inner = Window.partitionBy(*group, *sub).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(inner))
        .join(offsets, [*group, *sub])
        .withColumn(name, F.col("_offset") + F.col("_rank"))
        .drop("_offset", "_rank")
    )
