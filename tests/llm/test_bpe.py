import hashlib

import numpy as np
from helpers import docs, odd_docs, with_clashes

from hunkledger.llm import bpe

COLUMNS = ("n_tokens", "ids_sha256", "decoded_sha256")


def expected(text):
    text = text or ""
    enc = bpe.encoding(bpe.default_ranks())
    ids = [i for m in bpe.pattern().finditer(text) for i in enc._encode_single_piece(m.group().encode())]
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def check(df, rows, **options):
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, *(r[c] for c in COLUMNS)) for r in bpe.encode(df, **options).collect())
    assert got == sorted((i is not None, i or 0, *expected(t)) for i, t in rows)


def test_odd_rows_and_clashing_columns(spark):
    df = odd_docs(spark)
    check(df, [(r["doc_id"], r["text"]) for r in df.collect()])
    out = bpe.encode(with_clashes(df, "n_tokens"))
    assert out.columns.count("n_tokens") == 1 and "extra" in out.columns
    assert bpe.encode(df.limit(0)).count() == 0


def test_chunks_stitch_to_the_whole(spark):
    texts = [
        "The quick brown fox's 1234 jumps   over\n\n\nthe lazy dog!! " * 40,
        "word" * 400,  # one pre-token longer than chunk and overlap
        " " * 1000 + "x" + "\n" * 700 + " y",
        "é\U0001f600 ñandú 'll 've 12345678901234567890 " * 30,
        "a b" * 500, "!?" * 600 + " tail",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9, texts[0])]
    check(docs(spark, rows), rows, chunk=100, overlap=20)


def test_long_white_space(spark):
    rows = [(1, "a" + " " * 300_000 + "b"), (2, "\n" * 300_000)]
    check(docs(spark, rows), rows)
    check(docs(spark, rows), rows, chunk=1 << 20)
