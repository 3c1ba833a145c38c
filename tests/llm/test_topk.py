import random

from compare import compare, connect
from pyspark.sql import functions as F

from hunkledger.llm import topk

SF = "/root/testdata/sf0.01"


def brute(rows, is_query, k):
    import math

    ready = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, own in ready:
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in ready if i != q and len(v) == len(own))[:k]
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)}
    return out


def test_oracle(spark):
    ok, n, message = compare(topk.op3_top_k(spark, SF), connect(SF), topk.ORACLE)
    assert ok and n > 0, message


def test_small_blocks_ties_and_bad_vectors(spark):
    chance = random.Random(4)
    rows = [(i, [float(chance.randrange(-3, 4)) / 4 for _ in range(33)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 33) for i in range(20)]  # ties
    rows += [(300, None), (301, [None] * 33), (302, [float("nan")] * 33), (303, [float("inf")] * 33), (None, [0.1] * 33), (304, [1.0, 2.0]), (306, [2.0, 1.0]), (308, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 2 == 0, block_rows=32, query_rows=16).collect()}
    assert got == brute(rows, lambda i: i % 2 == 0, 5)


def test_large_numbers_are_exact(spark):
    rows = [(i, [3.0e6 + i, 2.0e6 - i, 1.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()} == brute(rows, lambda i: i == 0, 5)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, F.lit(True)).count() == 0


def test_repeated_rows(spark):
    """A repeated query asks once, a repeated candidate answers as often as it occurs; unlike vectors of one id rank apart."""
    rows = [(0, [1.0]), (0, [1.0]), (0, [-1.0]), (1, [3.0]), (1, [3.0]), (2, [2.0]), (3, [1.0]), (4, [0.5]), (5, [0.0]), (6, [-2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, block_rows=3, query_rows=1).collect())
    plus = [(1, 1, 3), (2, 1, 3), (3, 2, 2), (4, 3, 1), (5, 4, 0.5)]
    minus = [(1, 6, 2), (2, 5, 0), (3, 4, -0.5), (4, 3, -1), (5, 2, -2)]
    assert got == sorted((0, rank, vec, int(256 * 256 * x)) for rank, vec, x in plus + minus)
