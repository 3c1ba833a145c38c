"""Byte-level BPE encoding and decoding.

A text longer than ``chunk`` code points is cut into overlapping chunks that different tasks
pre-tokenise.  A scan that starts inside a pre-token is wrong at first, but as soon as one of its
boundaries meets a boundary of the chunk before it, both scans go on alike, because the pattern
looks only forward.  ``stitch`` cuts both chunks at the first such boundary.  Where none lies in the
overlap (one pre-token longer than the overlap) the two chunks are encoded as one.

Texts: NULL counts as empty (no ids).  Repeated rows keep one result each.  Extra columns pass
through; a column named like a result column is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CHUNK = 1 << 16
OVERLAP = 1 << 11
#: From this length on a run of white space is scanned outside the encoder.
LONG_SPACE = 20_000
_SPACE = re.compile(r"\s{%d}" % LONG_SPACE)

_RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=4)
def encoding(path: str):
    """The encoder and its byte strings by id."""
    import public_tokenizers
    import tiktoken

    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def digest(ids: np.ndarray, enc) -> tuple[int, str, str]:
    """Number of ids, hash of the ids, hash of the bytes they decode to."""
    raw = enc.decode_bytes(ids.tolist())
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()


def boundaries(text: str) -> list[int]:
    """Ends of the pre-tokens of ``text``, which also are the starts of the next ones."""
    return [m.end() for m in pattern().finditer(text)]


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(start, slice) of each chunk; a slice reaches ``overlap`` code points into the next chunk."""
    return [(s, text[s : s + chunk + overlap]) for s in range(0, max(len(text), 1), chunk)]


def edges(start: int, piece: str, chunk: int, last: bool) -> tuple[list[int], list[int]]:
    """Boundaries, in positions of the whole text, in the zone shared with the chunk before and with
    the one after.  A boundary at the very end of a slice is left out: more text could move it."""
    own = [0] + boundaries(piece)
    head = [start + b for b in own if b <= len(piece) - (0 if last else 1)]
    tail = [] if last else [b for b in head if b >= start + chunk and b < start + len(piece) - 1]
    return head, tail


def joined(tails: list[list[int]], heads: list[list[int]], starts: list[int]) -> list[int]:
    """Where each chunk begins after stitching: position 0, then the first boundary two neighbours
    share; -1 for a chunk that must be encoded together with the one before it."""
    begins = [0]
    for i in range(1, len(starts)):
        meet = set(tails[i - 1]) & set(heads[i])
        begins.append(min(meet) if meet else -1)
    return begins


def encode_text(text: str, enc) -> list[int]:
    """Ids of one text.  The encoder's own scan overflows its stack on white space runs of some
    hundred thousand characters, so a text with a long run is pre-tokenised here."""
    if len(text) >= LONG_SPACE and _SPACE.search(text):
        return [i for m in pattern().finditer(text) for i in enc._encode_single_piece(m.group().encode())]
    return enc.encode_ordinary(text)


def _encode_udf(path: str):
    @F.pandas_udf(_RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for texts in batches:
            ids = (np.asarray(encode_text(t, enc) if isinstance(t, str) else [], dtype=np.uint32) for t in texts)
            yield pd.DataFrame([digest(i, enc) for i in ids], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _chunk_udf(chunk: int, overlap: int):
    @F.pandas_udf("head array<long>, tail array<long>")
    def run(pieces: pd.Series, starts: pd.Series, totals: pd.Series) -> pd.DataFrame:
        rows = []
        for piece, start, total in zip(pieces, starts, totals):
            head, tail = edges(int(start), piece, chunk, start + chunk >= total)
            # only the zone shared with the chunk before is needed from the head
            rows.append(([b for b in head if b <= start + overlap] if start else [0], tail))
        return pd.DataFrame(rows, columns=["head", "tail"])

    return run


def _piece_udf(path: str):
    @F.pandas_udf("binary")
    def run(pieces: pd.Series) -> pd.Series:
        enc = encoding(path)
        return pd.Series([np.asarray(encode_text(p, enc), dtype="<u4").tobytes() for p in pieces])

    return run


def _join_udf(path: str):
    @F.pandas_udf(_RESULT)
    def run(parts: pd.Series) -> pd.DataFrame:
        enc = encoding(path)
        rows = [digest(np.frombuffer(b"".join(p["ids"] for p in ps), dtype="<u4"), enc) for ps in parts]
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _begins_udf():
    @F.pandas_udf("array<long>")
    def run(edges: pd.Series) -> pd.Series:
        out = []
        for chunks in edges:
            out.append(joined([list(c["tail"]) for c in chunks], [list(c["head"]) for c in chunks], [c["start"] for c in chunks]))
        return pd.Series(out)

    return run


def encode(docs: DataFrame, text: str = "text", ranks: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256 of each text.

    Short texts are encoded where they are read.  Long ones go through the chunk tables: edges of
    each chunk, one small row of edges a text, then the stitched pieces, each encoded by itself.
    """
    ranks = ranks or default_ranks()
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256")
    long_text = F.coalesce(F.length(text) > chunk, F.lit(False))
    short = docs.filter(~long_text).withColumn("__r", _encode_udf(ranks)(F.col(text)))
    # equal texts have equal results, so a text is known by its hash
    whole = docs.filter(long_text).withColumn("__key", F.sha2(text, 256))
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / chunk).cast("int"))
    pieces = (
        whole.select("__key", F.length(text).alias("total"), F.col(text).alias("t"), F.explode(starts).alias("no"))
        .select("__key", "total", (F.col("no") * chunk).alias("start"), F.substring("t", F.col("no") * chunk + 1, F.lit(chunk + overlap)).alias("piece"))
        .dropDuplicates(["__key", "start"])
    )
    marks = pieces.withColumn("e", _chunk_udf(chunk, overlap)("piece", "start", "total")).select("__key", F.struct("start", "e.head", "e.tail").alias("e"))
    begins = marks.groupBy("__key").agg(F.array_sort(F.collect_list("e")).alias("edges")).select("__key", _begins_udf()("edges").alias("begins"))
    spans = (
        whole.select("__key", F.col(text).alias("t")).join(begins, "__key")
        .withColumn("cuts", F.array_append(F.filter("begins", lambda b: b >= 0), F.length("t").cast("long")))
        .select("__key", "t", "cuts", F.explode(F.sequence(F.lit(1), F.size("cuts") - 1)).alias("no"))
        .withColumn("from", F.element_at("cuts", F.col("no")).cast("int"))
        .select("__key", "no", F.substring("t", F.col("from") + 1, F.element_at("cuts", F.col("no") + 1).cast("int") - F.col("from")).alias("piece"))
        .dropDuplicates(["__key", "no"])
    )
    ids = spans.withColumn("ids", _piece_udf(ranks)("piece")).groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts"))
    long_rows = whole.join(ids.select("__key", _join_udf(ranks)("parts").alias("__r")), "__key").drop("__key")
    return short.unionByName(long_rows).select("*", "__r.*").drop("__r")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
