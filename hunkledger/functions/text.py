"""Text, path and severity column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode White_Space, the set a full trim removes (Spark's own trim drops spaces only).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0 "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "    　"
)

SEVERITIES = ("INFO", "WARNING", "ERROR", "CRITICAL")
INT64_MAX = 9223372036854775807
TO_END = 2147483647

_INDEX_BITS, _BLOCK_UNIT = 33, 1 << 20


def trim_space(c: Column) -> Column:
    """Strip Unicode white space from both ends; linear in the text length."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def after(c: Column, n: int) -> Column:
    """Text without its first ``n`` characters."""
    return F.substring(c, n + 1, TO_END)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_ext(path: Column) -> Column:
    """Extension of the last path element, from its last dot."""
    base = base_name(path)
    return F.when(
        F.contains(base, F.lit(".")), F.concat(F.lit("."), F.substring_index(base, ".", -1))
    ).otherwise(F.lit(""))


def last_dot_ext(path: Column) -> Column:
    """Text from the last dot of the whole path, directories included."""
    return F.when(
        F.contains(path, F.lit(".")), F.concat(F.lit("."), F.substring_index(path, ".", -1))
    ).otherwise(F.lit(""))


def clean_path(path: Column) -> Column:
    """Lexical clean-up of a path: fold ``.``, ``..`` and empty elements."""
    rooted = F.startswith(path, F.lit("/"))
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        can_pop = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) != "..")
        return (
            F.when((part == "") | (part == "."), acc)
            .when((part == "..") & can_pop, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .when((part == "..") & rooted, acc)
            .otherwise(F.concat(acc, F.array(part)))
        )

    body = F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")
    return F.when(rooted, F.concat(F.lit("/"), body)).otherwise(
        F.when(body == "", F.lit(".")).otherwise(body)
    )


def dir_name(path: Column) -> Column:
    """Cleaned directory part; ``.`` when the path has none."""
    head = F.regexp_extract(path, r"(?s)\A(.*/)", 1)
    return clean_path(head)


def severity_rank(name: Column) -> Column:
    """Rank of a severity name; unknown names rank as INFO."""
    return (
        F.when(name == "WARNING", F.lit(1))
        .when(name == "ERROR", F.lit(2))
        .when(name == "CRITICAL", F.lit(3))
        .otherwise(F.lit(0))
    )


def severity_name(rank: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(s) for s in SEVERITIES]), rank), F.lit("UNKNOWN"))


def strip_fences(text: Column) -> Column:
    """Drop one leading ```` ```json ```` or ```` ``` ```` and one trailing ```` ``` ````."""
    t = trim_space(text)
    opened = (
        F.when(F.startswith(t, F.lit("```json")), after(t, 7))
        .when(F.startswith(t, F.lit("```")), after(t, 3))
        .otherwise(t)
    )
    closed = F.when(
        F.endswith(opened, F.lit("```")), F.left(opened, F.length(opened) - 3)
    ).otherwise(opened)
    return trim_space(closed)


def first_bytes(text: Column, n: int) -> Column:
    """The first ``n`` UTF-8 bytes; a character cut in half becomes U+FFFD."""
    cut = F.substring(F.encode(text, "utf-8"), 1, n).cast("string")
    return F.when(F.octet_length(text) <= n, text).otherwise(F.make_valid_utf8(cut))


def short_hash(*parts: Column) -> Column:
    """First 8 hex digits of SHA-256 over the parts joined by ``:``."""
    return F.left(F.sha2(F.concat_ws(":", *parts), 256), F.lit(8))


def add_wrapping(start: Column, k: Column) -> Column:
    """int64 ``start + k`` for ``k >= 0`` that wraps instead of failing on overflow.

    A diff header may carry any int64, and one hostile header must not fail a job.
    """
    low = F.lit(-INT64_MAX - 1)
    return F.when(start > F.lit(INT64_MAX) - k, (start - F.lit(INT64_MAX)) + (k - 1) + low).otherwise(
        start + k
    )


def folder_of(location: Column) -> Column:
    """Name of the folder that holds a file, from the URI form of the file's path."""
    decoded = F.url_decode(F.replace(location, F.lit("+"), F.lit("%2B")))
    return F.element_at(F.split(decoded, "/"), -2)


def split_place() -> Column:
    """Where a line of a text file stands: the start of its file split, in MiB, then its index in the task that reads the
    split.  Orders the lines of a file as long as splits are at least 1 MiB; must be selected straight from the reader."""
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    block = F.floor(F.col("_metadata.file_block_start") / _BLOCK_UNIT).cast("bigint")
    return F.shiftleft(block, _INDEX_BITS) + index
