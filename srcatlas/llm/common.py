"""Plumbing shared by the training-data operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir

#: Rows in one Arrow batch.  Documents average a few KB, so a batch stays at a
#: few MB and a Python worker never holds more than one of them.
ARROW_ROWS = 512
#: Bytes after which a batch ends early, so that long texts come a few at a time.
ARROW_BYTES = 8 << 20

_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one input table through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows handed to Python at once; long texts make rows large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    Cuts the lineage: whoever loses an executor rereads the files instead of
    computing the expensive part again.  The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/srcatlas/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove, spark)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Removes the files of a materialised table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for known in [p for p in _written if path.endswith(p.split(":", 1)[-1])]:
            _drop(spark, known)
            _written.remove(known)


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove(spark: SparkSession) -> None:
    try:
        for path in _written:
            _drop(spark, path)
    except Exception:  # the JVM has already ended; the shared folder's owner cleans up
        pass


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def fold(column, divisor: int):
    """crc32 of the id written as text, modulo ``divisor``."""
    return F.crc32(column.cast("string").cast("binary")) % divisor
