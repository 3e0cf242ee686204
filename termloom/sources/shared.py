"""The folder that driver and executors share, and results kept in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where that is unset, a fresh local folder serves a single-process session (tests);
    any other session raises, since its executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _local[context.applicationId]


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows starts from files
    that outlive any executor, and is not computed twice.

    The files belong to the session: they go when it ends, or with ``removed``.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession)
    df.write.parquet(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(path)
    back.kept_at = path
    return back


def removed(*frames: DataFrame) -> None:
    """Remove what ``kept`` wrote for these, once nothing reads them any more."""
    for df in frames:
        fs, at = _file_system(df.sparkSession, df.kept_at)
        fs.delete(at, True)
        fs.cancelDeleteOnExit(at)


#: Texts are long: so many of them in an Arrow batch.
TEXTS = 1000


def texts_a_batch(spark: SparkSession) -> None:
    """Bound the texts of an Arrow batch where the session has Spark's own number, set or not."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(TEXTS))
