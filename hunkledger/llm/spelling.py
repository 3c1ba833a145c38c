"""Spelling variant grouping by pivotal grams.

Words that differ by one inserted, deleted or replaced character are near.  With bigrams ordered from rare to frequent,
a word's *prefix* is its three rarest bigrams (2 * 1 edits + 1, and all places of the third); its *pivots* are two of them that do
not overlap, chosen by dynamic programming so that the lists they open are shortest.  One edit leaves one of two disjoint pivots whole, and
if the prefix of word a ends no later in the order than that of b, that pivot stands in the prefix of b too.  So near words meet where a pivot of
one is in the prefix of the other.

The pivot's place may differ only by the edit, which sharpens the index: the edit lies on one side of the whole pivot, so either the words are equal
from their beginning through the pivot, or from the pivot to their end.  The index therefore holds each gram with its word's beginning and with its
word's end.  Candidates are verified in the join itself, so that only links leave it.  Keys that no pivot looks up are dropped first; a key with many words is
cut into blocks on both sides (``BLOCK``), so no task holds or compares a whole one.

Counting words, grams and links combines before it shuffles.  The driver reads the counts of the bigrams (at most 90 * 90 for this alphabet) and the largest count of a word;
the words, keys and links are tables.

A word's form is its near word of largest count, if that is ``FORM_TIMES`` its own; counts grow along forms, so following them ends; roots are found by doubling the
step.

Defined results: a NULL or empty text, and one without a long enough run, gives no words.  In a row without an id no run loses a character.  Repeated rows count each.
Runs of any length are words.  Ties of forms go to the smaller word in code-point order.  An empty table gives no rows.  Extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .merkle import CRC_TABLE, crc32_sql

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: How many times more often a form must occur.
FORM_TIMES = 5
#: One run in so many loses a character.
DROP_EVERY = 199
#: Words of a key that are compared in one piece with as many others.
BLOCK = 2_000
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM, EDITS = 2, 1
PREFIX = GRAM * EDITS + 1


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n) of the words that occur often enough."""
    # a character less makes no run longer, so shorter runs are not even cut out
    runs = F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}{{{least_length},}}+"), F.lit(0))
    rows = docs.select(F.concat(F.col(doc_id).cast("string"), F.lit(":")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % drop_every == 0, less).otherwise(F.col("run"))
    counted = rows.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.col("n") >= least_count) & (F.length("word") >= least_length))


def gram_counts(words: DataFrame) -> dict[str, int]:
    """How many words' places hold each bigram; as many entries as there are pairs of letters."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.select(F.explode(F.transform(places, lambda i: F.substring(F.col("word"), i, F.lit(GRAM)))).alias("gram"))
    return {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.count("*").alias("n")).collect()}


def prefix_of(word: str, rank: dict[str, int]) -> tuple[list[int], int]:
    """Places of the rarest bigrams, in order of place, and the rank of the last of them; every place of an equal last bigram is in."""
    ranks = [rank[word[i : i + GRAM]] for i in range(len(word) - GRAM + 1)]
    last = sorted(ranks)[: PREFIX][-1]
    return [i for i, r in enumerate(ranks) if r <= last], last


def pivots_of(places: list[int], costs: list[int], wanted: int = EDITS + 1) -> list[int]:
    """The ``wanted`` places, no two of them overlapping, with the least cost in all; fewer if there are no more.

    best[k] is the cheapest choice of k places among those seen so far; ``free`` looks back to what ends before a place.
    """
    seen: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] + [None] * wanted]
    for number, (place, cost) in enumerate(zip(places, costs)):
        free = number
        while free and places[free - 1] > place - GRAM:
            free -= 1
        best = list(seen[-1])
        for k in range(1, wanted + 1):
            before = seen[free][k - 1]
            if before and (best[k] is None or before[0] + cost < best[k][0]):
                best[k] = (before[0] + cost, (*before[1], place))
        seen.append(best)
    return list(next(found for found in reversed(seen[-1]) if found)[1])


def _grams_udf(counts: dict[str, int]):
    rank = {gram: r for r, gram in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}

    @F.pandas_udf("prefix array<int>, pivots array<int>, last int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for words in batches:
            out = []
            for word in words:
                places, last = prefix_of(word, rank)
                out.append((places, pivots_of(places, [counts[word[i : i + GRAM]] for i in places]), last))
            yield pd.DataFrame(out, columns=["prefix", "pivots", "last"])

    return run


def keys(words: DataFrame, counts: dict[str, int]) -> DataFrame:
    """key, word, n, last, pivot: each prefix gram of each word with the word's beginning and with its end."""
    rows = words.select("word", "n", _grams_udf(counts)("word").alias("g"))
    rows = rows.select("word", "n", F.col("g.last").alias("last"), F.col("g.pivots").alias("pivots"), F.explode("g.prefix").alias("at"))
    begin = F.xxhash64(F.lit("begin"), F.substring("word", F.lit(1), F.col("at") + GRAM))
    end = F.xxhash64(F.lit("end"), F.substring("word", F.col("at") + 1, F.length("word")))
    return rows.select(F.explode(F.array(begin, end)).alias("key"), "word", "n", "last", F.array_contains("pivots", F.col("at")).alias("pivot"))


def links(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, an, b, bn): each pair of near words at least once, with their counts."""
    counts = gram_counts(words)
    index = stage(keys(words, counts), "spelling-keys")
    sizes = index.groupBy("key").agg(F.count("*").alias("held"), F.count_if("pivot").alias("asked")).filter("held > 1 AND asked > 0")
    blocks = lambda n: F.ceil(n / block).cast("int")
    live = index.join(sizes.select("key", blocks(F.col("held")).alias("i"), blocks(F.col("asked")).alias("j")), "key")
    dealt = lambda salt, n: F.pmod(F.xxhash64("word", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = live.filter("pivot").select("key", every("i").alias("i"), dealt(2, "j").alias("j"), F.col("word").alias("a"), F.col("n").alias("an"), F.col("last").alias("al"))
    there = live.select("key", dealt(1, "i").alias("i"), every("j").alias("j"), F.col("word").alias("b"), F.col("n").alias("bn"), F.col("last").alias("bl"))
    near = (
        (asking["key"] == there["key"]) & (asking["i"] == there["i"]) & (asking["j"] == there["j"])
        & (F.col("al") <= F.col("bl")) & (F.abs(F.length("a") - F.length("b")) <= EDITS) & (F.levenshtein("a", "b", EDITS) == EDITS)
    )
    return asking.join(there, near).select("a", "an", "b", "bn")


def near_words(pairs: DataFrame) -> DataFrame:
    """word, n_near and best (its near word of largest count, with that count); words without a near one are missing."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn")))
    once = both.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("near_n")).distinct()
    return once.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))


def roots(forms: DataFrame, most: int, times: int = FORM_TIMES, least: int = LEAST_COUNT) -> DataFrame:
    """(word, root) of the words with a form: the last of their forms."""
    steps, n = 1, least
    while n * times <= most:
        steps, n = steps + 1, n * times
    now = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(int(log2(steps)) + 1):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stage(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return now


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each frequent word."""
    words = stage(word_counts(docs, doc_id, text), "spelling-words")
    most = words.agg(F.max("n")).first()[0]
    near = near_words(links(words, block))
    form_n: Column = -F.col("best.less")
    formed = form_n >= FORM_TIMES * F.col("n")
    told = stage(words.join(near, "word", "left").select(
        "word", F.when(formed, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, form_n).alias("form_n"),
    ), "spelling-forms")
    ends = roots(told.filter("form IS NOT NULL"), most or 0)
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


_BYTES = "flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))"

ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{6,}}')), '{UPPER}', '{LOWER}') AS run FROM documents
), told AS (
    SELECT run, length(run) AS len, count(*) AS n, CASE WHEN doc_id IS NULL THEN 1 ELSE {crc32_sql(_BYTES.format("doc_id::VARCHAR || ':' || run"))} END AS h
    FROM runs, crc GROUP BY doc_id, run, t
), words AS (
    SELECT CASE WHEN h % {DROP_EVERY} = 0 THEN substr(run, 1, (h % len)::BIGINT) || substr(run, (h % len)::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
    FROM told GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT} AND length(word) >= {LEAST_LENGTH}
), less AS (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)
), near AS (
    SELECT DISTINCT word, near, near_n FROM (
        SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION ALL SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
        UNION ALL SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
    )
), best AS (
    SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
    QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1
), forms AS (
    SELECT w.word, CASE WHEN near_n >= {FORM_TIMES} * w.n THEN near END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {FORM_TIMES} * w.n THEN near_n END AS form_n
    FROM words w LEFT JOIN best USING (word)
), ends(word, root) AS (
    SELECT word, word FROM forms
    UNION ALL
    SELECT e.word, f.form FROM ends e JOIN forms f ON f.word = e.root AND f.form IS NOT NULL
)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n
FROM forms f JOIN ends e ON e.word = f.word JOIN forms l ON l.word = e.root AND l.form IS NULL
"""
