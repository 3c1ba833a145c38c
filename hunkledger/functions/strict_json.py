"""Strict JSON decoding on the JVM, without Python workers.

Spark's JSON functions stop after the first value and ignore what follows.  The
text is therefore parsed as the first element of a two-element array whose second
element is a hash of the text: extra values move the hash away, and text that
closes the array early loses it, so the hash is found only after one whole value.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def keep_last_key(spark: SparkSession) -> None:
    """Let an object repeat a key, as the log's writers may; the last value counts.

    Spark refuses such objects unless the session allows them, and a refused object would
    silently drop its row, so every decoder calls this before it builds its plan.
    """
    if spark.conf.get(_REPEATED_KEYS, "false").lower() != "true":
        spark.conf.set(_REPEATED_KEYS, "true")


def strict_variant(text: Column) -> Column:
    """The text as a variant when it is exactly one JSON value, else NULL."""
    seal = F.xxhash64(text).cast("string")
    sealed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), seal, F.lit('"]')))
    intact = F.try_variant_get(sealed, "$[1]", "string") == seal
    return F.when(intact, F.try_variant_get(sealed, "$[0]", "variant"))


def type_of(v: Column, path: str) -> Column:
    """Type name of a member; VOID for JSON null and for a missing member."""
    member = F.try_variant_get(v, path, "variant")
    return F.coalesce(F.schema_of_variant(member), F.lit("VOID"))


def is_text(v: Column, path: str) -> Column:
    return type_of(v, path).isin("STRING", "VOID")


def is_int(v: Column, path: str) -> Column:
    return type_of(v, path).isin("BIGINT", "VOID")


def is_number(v: Column, path: str) -> Column:
    return F.rlike(type_of(v, path), F.lit(r"^(BIGINT|DECIMAL|DOUBLE|VOID)"))


def is_bool(v: Column, path: str) -> Column:
    return type_of(v, path).isin("BOOLEAN", "VOID")


def is_array(v: Column, path: str) -> Column:
    member = F.try_variant_get(v, path, "variant")
    return (
        member.isNull()
        | F.is_variant_null(member)
        | F.try_variant_get(member, "$", "array<variant>").isNotNull()
    )


def is_object(v: Column, path: str = "$") -> Column:
    """Object, JSON null or missing: all three decode into a record."""
    member = F.try_variant_get(v, path, "variant")
    return (
        member.isNull()
        | F.is_variant_null(member)
        | F.try_variant_get(member, "$", "map<string,variant>").isNotNull()
    )


def text_at(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def long_at(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "bigint"), F.lit(0).cast("bigint"))


def items_at(v: Column, path: str) -> Column:
    """Array member as ``array<variant>``; empty when missing or null."""
    return F.coalesce(
        F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>")
    )
