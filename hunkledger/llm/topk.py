"""Exact top-k by inner product: columnar branch and bound.

Vectors lie in blocks, dimension by dimension (vertical layout).  A query goes over a block's
dimensions in groups; after each group a candidate's score so far plus the most that the rest can
add (product of the norms of both rests) bounds its score.  Candidates below the query's k-th best
are dropped and the survivors moved together before the next group.

Candidates are cut into blocks by a hash of the id and queries into blocks of their own.  Every
pair of blocks is one task's unit of work and leaves k rows a query; a ranking over those follows.

Vectors that are NULL or hold a NULL, NaN or infinite component take no part; nor do rows without
an id.  Vectors of different lengths are compared only with their like.  Ties go to the smaller id;
a repeated id is a candidate as often as it occurs.  A query that stands several times, with the same
id and vector, asks once; unlike vectors under one id each get a ranking of their own.  No row
answers a query of its own id.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K = 5
QUERY_EVERY = 50
#: Rows of a candidate block and of a query block; a pair of blocks is what a task holds at a time.
BLOCK_ROWS = 8_192
QUERY_ROWS = 8_192
#: Dimensions between two prunings.
STEP = 16


def quantised(vectors: DataFrame, vector: str) -> DataFrame:
    """Integer vectors ``v``, with their length ``dim``; unusable vectors left out."""
    whole = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.filter(whole).withColumn(
        "v", F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))
    ).withColumn("dim", F.size("v"))


def best_in_block(queries: np.ndarray, ids: np.ndarray, block: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, candidate ids, scores) of the k best of a block for each query.

    queries: q x d; block: d x n, ascending by id within equal norms; own: ids of the queries.
    Scores are exact in float64 as long as they stay below 2**53; ``scores`` of larger vectors are
    added up in wrapping 64-bit integers, without pruning.
    """
    d, n = block.shape
    largest = float(max(np.abs(queries).max(initial=0), 1)) * float(max(np.abs(block).max(initial=0), 1)) * max(d, 1)
    if largest >= 2.0**53:
        for row in range(len(queries)):
            yield (row, *ranked(ids, queries[row] @ block, own[row], k))
        return
    cuts = list(range(0, d, STEP)) + [d]
    column = block.astype(np.float64)
    rest = [np.sqrt((column[c:] ** 2).sum(axis=0)) for c in cuts[1:]]
    for row in range(len(queries)):
        query = queries[row].astype(np.float64)
        seed = query @ column[:, : 4 * k]
        seed = seed[ids[: 4 * k] != own[row]]
        least = np.partition(seed, len(seed) - k)[len(seed) - k] if len(seed) >= k else -np.inf
        alive = np.arange(n)
        score = np.zeros(n)
        values, left = column, rest
        for step in range(len(cuts) - 1):
            score = score + query[cuts[step] : cuts[step + 1]] @ values[cuts[step] : cuts[step + 1]]
            bound = score + np.sqrt((query[cuts[step + 1] :] ** 2).sum()) * left[step] * (1 + 1e-12) + 1e-6
            kept = np.flatnonzero(bound >= least)
            if len(kept) < 0.5 * len(alive):
                alive, score = alive[kept], score[kept]
                values, left = values[:, kept], [r[kept] for r in left]
        yield (row, *ranked(ids[alive], score.astype(np.int64), own[row], k))


def ranked(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id, without the query itself."""
    other = ids != own
    ids, scores = ids[other], scores[other]
    if len(ids) > k:
        near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def top_k(vectors: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest other rows of each row where ``is_query``."""
    ready = quantised(vectors.select(F.col(vec_id).cast("long").alias("id"), vector, is_query.alias("query")).filter(F.col("id").isNotNull()), vector).select("id", "v", "dim", "query")
    total = ready.count()
    n_blocks = max(1, -(-total // block_rows))
    n_query_blocks = max(1, -(-ready.filter("query").count() // query_rows))
    hashed = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    rows = ready.withColumn("block", (hashed % n_blocks).cast("int"))
    # a block and a group of queries meet once; the smaller part, the queries, is what is repeated
    cells = rows.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1)))).select("dim", "block", "qblock", "id", "v", F.lit(0).cast("long").alias("asked"), F.lit(False).alias("query"))
    asked = (
        rows.filter("query").dropDuplicates(["id", "v"]).withColumn("qblock", (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 40)) % n_query_blocks).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select("dim", "block", "qblock", "id", "v", F.xxhash64("v").alias("asked"), F.lit(True).alias("query"))
    )

    names = ("query_id", "asked", "vec_id", "score")

    def search(cell: pd.DataFrame) -> pd.DataFrame:
        asked = cell[cell["query"]].sort_values("id")
        there = cell[~cell["query"]].sort_values("id")
        if not len(asked) or not len(there):
            return pd.DataFrame({name: [] for name in names}).astype("int64")
        block = np.stack(there["v"].to_list()).astype(np.int64)
        order = np.argsort(-(block.astype(np.float64) ** 2).sum(axis=1), kind="stable")
        ids, block = there["id"].to_numpy()[order], np.ascontiguousarray(block[order].T)
        queries, own = np.stack(asked["v"].to_list()).astype(np.int64), asked["id"].to_numpy()
        which = asked["asked"].to_numpy()
        found = [(np.full(len(i), own[row]), np.full(len(i), which[row]), i, s) for row, i, s in best_in_block(queries, ids, block, own, k)]
        return pd.DataFrame({name: np.concatenate([f[p] for f in found]) for p, name in enumerate(names)})

    near = cells.unionByName(asked).groupBy("dim", "block", "qblock").applyInPandas(search, "query_id long, asked long, vec_id long, score long")
    order = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


ORACLE = """
WITH ready AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, q.v AS asked, c.vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM (SELECT DISTINCT vec_id, v FROM ready WHERE vec_id % 50 = 0) q
    JOIN ready c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) <= 5
"""
