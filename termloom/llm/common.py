"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.sources.shared import kept, removed

#: Internal columns start with this, so that a caller's columns never clash.
P = "__llm_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder (``spark.checkpoint.dir``) and read it back.

    The plan above starts from files that outlive any executor, and the file
    sizes give the optimizer real statistics.  The files go with ``discard``, or when the session ends.
    """
    return kept(df)


def discard(*frames: DataFrame) -> None:
    """Remove what ``durable`` wrote for these, once nothing reads them any more."""
    removed(*frames)


#: Texts are long: an Arrow batch holds so many rows and, where Spark knows the setting, bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches, unless the session says otherwise.

    These two settings of the session are the only ones that the operators touch; each
    keeps a value that the caller gave it.
    """
    for key, usual, own in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", None, BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        if now is not None and (now == usual or usual is None and not 0 < int(now) < (1 << 31) - 1):
            spark.conf.set(name, str(own))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` only: extra columns, whatever their names, stay out."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def held_out(doc_id: Column) -> Column:
    """The evaluation fold: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hash_fraction(*cols: Column) -> Column:
    """A reproducible number in [0, 1) from the values of the columns."""
    return F.pmod(F.xxhash64(F.lit("sample"), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))
