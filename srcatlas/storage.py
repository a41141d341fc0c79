"""Where lineage is cut: the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only on one machine, where it may be unset, a temporary one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return named or found.get()
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    named = named or tempfile.mkdtemp(prefix="srcatlas-")
    context.setCheckpointDir(named)
    return named


def delete(spark: SparkSession, path: str) -> bool:
    """Removes a file or folder of any store that Spark reaches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_rounds: set[str] = set()
_tables: list[str] = []
_RUN = uuid.uuid4().hex


def fresh(spark: SparkSession) -> str:
    """A new path in the shared folder, there until the driver ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/srcatlas/rounds-{_RUN}"
    if folder not in _rounds:
        _rounds.add(folder)
        atexit.register(_forget, spark, folder)
    return f"{folder}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder: computed once, cut from its lineage, there until the driver ends."""
    spark = df.sparkSession
    path = fresh(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, parts: int) -> DataFrame:
    """``df`` written once, as a table in the shared folder whose rows are read by ``column`` without a shuffle.

    Rows that are dealt out by ``column`` to so many tasks are one file a bucket.
    """
    spark = df.sparkSession
    path = fresh(spark)
    name = f"srcatlas_{path.rsplit('/', 1)[1]}"
    df.write.format("parquet").bucketBy(parts, column).option("path", path).saveAsTable(name)
    _tables.append(name)
    return spark.table(name)


def _forget(spark: SparkSession, folder: str) -> None:
    try:
        while _tables:
            spark.sql(f"drop table if exists {_tables.pop()}")
        delete(spark, folder)
    except Exception:  # the JVM has already ended; the shared folder's owner cleans up
        pass
