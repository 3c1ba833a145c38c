"""Helpers the operators share: table access, folds, text batches, staged tables."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkledger.session import work_path

#: Code points handled together inside a task; bounds the memory of the numpy work.
BATCH_CHARS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; every query starts here, so the executors get the code here."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    """True for fold 0.  A row without an id is in no fold: it is neither held out nor learned from."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def in_batches(texts: Iterable[str | None], limit: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Consecutive texts in lists of about ``limit`` code points; NULL becomes the empty text."""
    held, chars = [], 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        held.append(text)
        chars += len(text) + 1
        if chars >= limit:
            yield held
            held, chars = [], 0
    if held:
        yield held


def stage(df: DataFrame, name: str, **options) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of text that cross to Python together.
ARROW_ROWS = 1_000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once an application, so that they need no installation of it, and
    let rows of text reach Python in smaller batches than Spark's default, unless the session says how many."""
    if spark.conf.get(_ARROW_ROWS) == "10000":
        spark.conf.set(_ARROW_ROWS, str(ARROW_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="hunkledger-code-")) / "hunkledger_code.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for source in sorted(package.rglob("*.py")):
                archive.write(source, source.relative_to(package.parent))
        context.addPyFile(str(target))
        _SHIPPED.add(context.applicationId)
    return spark
