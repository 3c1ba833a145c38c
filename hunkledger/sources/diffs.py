"""Raw diffs as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import folder_of, split_place
from ..operators.diffs import is_blank
from ..schemas import DIFFS


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """Diffs table (parquet): scan_id, repo, scan_ts, raw, and whether raw is blank."""
    return spark.read.schema(DIFFS).parquet(path).withColumn("is_empty", is_blank(F.col("raw")))


def read_diff_files(spark: SparkSession, path: str) -> DataFrame:
    """Diffs kept as one text file per scan, ``<repo>/<anything>.diff``.

    The scan id is a hash of the file's path, the scan time its modification time.
    """
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    location = F.col("_metadata.file_path")
    return files.select(
        F.xxhash64(location).alias("scan_id"),
        folder_of(location).alias("repo"),
        F.col("_metadata.file_modification_time").alias("scan_ts"),
        F.col("value").alias("raw"),
    ).withColumn("is_empty", is_blank(F.col("raw")))


def read_diff_lines(spark: SparkSession, path: str) -> DataFrame:
    """Diffs of any size, kept as in ``read_diff_files``, as the lines that ``cut_diffs`` takes.

    A file is read in splits, by many tasks.  ``line_no`` is made from the split's start and the line's index
    in the task, so it orders a file's lines without a shuffle but has gaps.  An empty file has no lines.
    """
    files = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    location = F.col("_metadata.file_path")
    return files.select(
        F.xxhash64(location).alias("scan_id"), folder_of(location).alias("repo"), split_place().alias("line_no"),
        F.col("value").alias("text"),
    )
