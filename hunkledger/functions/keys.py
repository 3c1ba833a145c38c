"""Keep wide rows out of a shuffle that a join by key would drop after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the key filter: 2 MB, whatever the tables hold.  With four million keys a quarter of the other rows pass.
KEY_BITS = 1 << 24


def may_meet(rows: DataFrame, others: DataFrame, keys: list[str], bits: int = KEY_BITS) -> DataFrame:
    """``rows`` without most of those whose keys are not in ``others``; all that are in it stay.

    The hashed keys of ``others`` become one bitmap of fixed size that every task reads.  A join must follow; it
    then shuffles few rows that meet nobody.  ``others`` is read once more: stage it if it is costly.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(bits))
    marked = others.select(bit.alias("_bit")).groupBy((F.col("_bit") / 64).cast("bigint").alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(_bit % 64 AS INT))")).alias("_word")
    )
    words = rows.sparkSession.range(bits // 64).join(marked, "id", "left").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("id", F.coalesce("_word", F.lit(0).cast("bigint")).alias("w")))), lambda x: x["w"]
        ).alias("words")
    )
    word = F.get(words.scalar(), (bit / 64).cast("int"))
    return rows.where(F.getbit(word, (bit % 64).cast("int")) == 1)
