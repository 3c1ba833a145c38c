"""A training corpus from raw documents: language ID, near-dedup, decontamination, PII, tokens.

Every stage reads what its predecessor kept, as Parquet in the shared folder, so a lost executor never
repeats an earlier stage.  All stages but the last return the columns of ``documents``; other columns
pass through.  NULL texts leave at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkledger.llm import bpe, decontaminate, lang, minhash, pii
from hunkledger.llm.common import fold, ship, stage, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages from the documents that name theirs; documents without a letter go.  A missing
    language is filled in with the predicted one."""
    ship(spark)
    prototypes = lang.fit(docs.filter(fold(F.col("doc_id")) != 0))
    told = lang.predict(docs, prototypes)
    wanted = F.col("lang_pred") != "und" if prototypes else F.col("text").rlike(r"\p{L}")
    kept = told.filter(wanted)
    if prototypes:
        kept = kept.withColumn("lang", F.coalesce("lang", "lang_pred"))
    return kept.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays, once.  Rows without an id stay.

    An id that stands for unlike texts names no document, so all its texts stay; only rows equal in id and text are one.
    """
    ship(spark)
    text = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    named = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(text).alias("lo"), F.max(text).alias("hi"))
    several = stage(named.filter("lo <> hi").select("doc_id"), "pipeline-unlike-texts")
    rest, clear = docs.filter("doc_id IS NULL"), docs
    if not several.isEmpty():
        clear = docs.join(several, "doc_id", "left_anti")
        rest = rest.unionByName(docs.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns))
    classes = minhash.near_duplicates(clear)
    first = classes.filter(F.col("doc_id") == F.col("class_id")).select("doc_id").distinct()
    kept = clear.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(docs.columns).unionByName(rest.select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship(spark)
    return decontaminate.match(docs, table(spark, sf_dir, "benchmark")).filter(F.size("matches") == 0).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every private span becomes its kind in brackets; ``n_chars`` follows the text."""
    found = pii.redact(pii.find(docs, pii.fit(docs)))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count, and hashes of the ids and of the text they decode to."""
    ship(spark)
    return bpe.encode(docs).select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", language_id),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("PII", personal_data),
    ("byte-level BPE", tokens),
]

#: Language vectors, signatures, boosted trees and BPE are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
    return docs
