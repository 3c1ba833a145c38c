"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  The vector of a trigram binds (multiplies) those of
its letters, each rotated by its place; the vector of a text bundles (adds) its trigrams'.  A
language's prototype bundles all its training texts.  A text gets the language whose prototype,
less the mean of all prototypes, has the highest cosine with it.

NULL text or text without a letter: ``und`` with score 0.  Equal cosines: the smaller language.
No training text at all: every text is ``und``.  Repeated rows each get a result; extra columns pass
through, one named like a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, held_out, in_batches, table

DIM = 512
SEED = 20_231
#: Letters share so many codes: a to z have their own, others are spread over the rest; 0 is "no letter".
SYMBOLS = 64
GRAMS = SYMBOLS**3


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Code of every code point of a lower-cased text."""
    codes = np.zeros(0x110000, dtype=np.int32)
    for point in range(0x110000):
        if chr(point).isalpha():
            codes[point] = 27 + (point * 2_654_435_761 >> 7) % (SYMBOLS - 27)
    codes[97:123] = np.arange(1, 27)
    return codes


@lru_cache(maxsize=4)
def letters(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), size=(SYMBOLS, dim))


def gram_vectors(grams: np.ndarray, dim: int, seed: int) -> np.ndarray:
    own = letters(dim, seed)
    first, second, third = grams // SYMBOLS**2, grams // SYMBOLS % SYMBOLS, grams % SYMBOLS
    return np.roll(own, 2, axis=1)[first] * np.roll(own, 1, axis=1)[second] * own[third]


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram ids that occur, and the matrix texts x those ids of how often.  A text begins and ends with a
    gap, and a run of characters that are no letters is one gap."""
    lowered = [f" {t.lower()} " for t in texts]
    code = symbols()[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    ends = np.cumsum([len(t) for t in lowered])
    kept = (code != 0) | (np.concatenate(([0], code[:-1])) != 0)
    kept[ends - [len(t) for t in lowered]] = True
    kept = np.flatnonzero(kept)
    code, doc = code[kept], np.searchsorted(ends, kept, side="right")
    grams = code[:-2] * SYMBOLS**2 + code[1:-1] * SYMBOLS + code[2:]
    same = doc[:-2] == doc[2:]
    grams, doc = grams[same], doc[:-2][same]
    there = np.flatnonzero(np.bincount(grams, minlength=GRAMS))
    place = np.zeros(GRAMS, dtype=np.int64)
    place[there] = np.arange(len(there))
    counts = np.bincount(doc * len(there) + place[grams], minlength=len(texts) * len(there))
    return there, counts.reshape(len(texts), len(there))


def fit(train: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM, seed: int = SEED) -> dict[str, list[int]]:
    """Prototype of each language, from all training rows with text and language.

    Every task adds up its own texts; a row for each language, dimension and task is shuffled.  The
    result has ``dim`` numbers a language.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, texts in batch.groupby("lang")["text"]:
                for held in in_batches(texts):
                    there, counts = gram_counts(held)
                    if len(there):
                        vector = counts.sum(axis=0) @ gram_vectors(there, dim, seed).astype(np.int64)
                        sums[name] = sums.get(name, 0) + vector
        for name, vector in sums.items():
            yield pd.DataFrame({"lang": name, "place": np.arange(dim), "value": vector})

    usable = train.select(F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    sums = usable.mapInPandas(add, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    prototypes: dict[str, list[int]] = {}
    for row in sums.collect():
        prototypes.setdefault(row["lang"], [0] * dim)[row["place"]] = row["value"]
    return dict(sorted(prototypes.items()))


def centred(prototypes: dict[str, list[int]]) -> np.ndarray:
    """Unit prototypes less their mean, as unit vectors; a single one stays as it is."""
    rows = np.array(list(prototypes.values()), dtype=np.float64)
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    if len(rows) > 1:
        rows = rows - rows.mean(axis=0)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, prototypes: dict[str, list[int]], text: str = "text", dim: int = DIM, seed: int = SEED) -> DataFrame:
    """Add lang_pred and score (the cosine with the chosen prototype, at least 0)."""
    names = list(prototypes)
    targets = centred(prototypes).T.astype(np.float32) if names else None

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[tuple[str, float]] = []
            for texts in in_batches(batch):
                there, counts = gram_counts(texts)
                if targets is None or not len(there):
                    found += [("und", 0.0)] * len(texts)
                    continue
                vectors = counts.astype(np.float32) @ gram_vectors(there, dim, seed).astype(np.float32)
                size = np.linalg.norm(vectors, axis=1)
                cosine = (vectors @ targets) / np.maximum(size, 1e-9)[:, None]
                best = cosine.argmax(axis=1)
                some = counts.any(axis=1)
                found += [
                    (names[b], float(min(max(c[b], 0.0), 1.0))) if s else ("und", 0.0)
                    for b, c, s in zip(best, cosine, some)
                ]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return docs.drop("lang_pred", "score").withColumn("__r", run(F.col(text))).select("*", "__r.*").drop("__r")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = fit(docs.filter(fold(F.col("doc_id")) != 0))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, prototypes).select("doc_id", "held_out", "lang_pred", "score")
