"""Incremental indexing and running attempt state with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import selected
from ..operators import annotations
from ..operators.attempts import upsert
from ..schema import EXCLUDE, INCLUDE
from ..storage import delete, shared_dir, written

BUCKETS = 16
#: What the table of indexed files is called after, and changed files read at once.
FILES, REREAD = "_files", 1000
#: Where buckets wait until they are put in place.
NEXT = "_next"


def changed_files(spark: SparkSession, root: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE, per_trigger: int = 1000) -> DataFrame:
    """New and changed files below ``root`` as a stream of path, modified_at and content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)
    kept = stream.where(selected(F.col("path"), include, exclude))
    return kept.select("path", F.col("modificationTime").alias("modified_at"), F.col("content").cast("string").alias("content"))


def bucketed(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int"))


def upsert_annotations(target: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A batch function that replaces the annotations of changed files.

    The table is partitioned by a hash of the path; a batch rewrites only the
    buckets that its files fall in, and running it twice changes nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy("path").agg(F.max_by("content", "modified_at").alias("content"))
        fresh = bucketed(annotations.annotations(annotations.lines(newest)), buckets)
        touched = bucketed(newest.select("path"), buckets)
        old = _existing(spark, target)
        if old is None:
            kept = fresh.limit(0)
        else:
            hit = touched.select("bucket").distinct()
            kept = old.join(F.broadcast(hit), "bucket", "left_semi").join(touched.select("path"), "path", "left_anti").select(*fresh.columns)
        _replace(kept.unionByName(fresh), touched, target)
        files(batch.select("path", "modified_at"), 0)

    files = upsert_state(target + FILES, ["path"], "modified_at", buckets)
    return write


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _existing(spark: SparkSession, target: str) -> DataFrame | None:
    """The table at ``target``, or nothing before the first batch and when no row is left."""
    if _there(spark, target + NEXT + "/rows/_SUCCESS"):
        _put(spark, target)
    spark.catalog.refreshByPath(target)
    if not _there(spark, target) or not spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(target).select("path").head(1):
        return None
    return spark.read.parquet(target)


def _replace(rows: DataFrame, touched: DataFrame, target: str) -> None:
    """Puts ``rows`` in place of all of the touched buckets; those without rows go.

    The new buckets are written whole beside the table first.  If the job stops
    while it puts them in place, the next one that opens the table does it again.
    """
    spark = rows.sparkSession
    touched.select("bucket").distinct().write.mode("overwrite").parquet(target + NEXT + "/touched")
    rows.write.mode("overwrite").parquet(target + NEXT + "/rows")
    _put(spark, target)


def _put(spark: SparkSession, target: str) -> None:
    rows, touched = spark.read.parquet(target + NEXT + "/rows"), spark.read.parquet(target + NEXT + "/touched")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)
    for gone in touched.join(rows.select("bucket").distinct(), "bucket", "left_anti").collect():  # at most a row a bucket
        delete(spark, f"{target}/bucket={gone['bucket']}")
    delete(spark, target + NEXT)


def refresh(spark: SparkSession, root: str, target: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE, buckets: int = BUCKETS) -> None:
    """Indexes known files again that changed since, and forgets those that went.

    A file stream takes every path once, so changes and deletions are found by
    comparing the listing with the times in the table of indexed files.
    """
    known, old = _existing(spark, target + FILES), _existing(spark, target)
    if known is None or old is None:
        return
    schema = "path string, modificationTime timestamp, length long, content binary"
    there = spark.read.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    there = there.where(selected(F.col("path"), include, exclude)).select("path", F.col("modificationTime").alias("now"))
    lost = written(known.select("path").join(there, "path", "left_anti"))
    changed = written(there.join(known, "path").where("now > modified_at").select("path"))
    if not lost.isEmpty():
        for table, rows in ((target, old), (target + FILES, known)):
            touched = bucketed(lost, buckets)
            kept = rows.join(F.broadcast(touched.select("bucket").distinct()), "bucket", "left_semi").join(lost, "path", "left_anti")
            _replace(kept.select(*rows.columns), touched, table)
    write = upsert_annotations(target, buckets)
    paths = (r["path"] for r in changed.toLocalIterator())
    while some := list(islice(paths, REREAD)):
        rows = spark.read.format("binaryFile").schema(schema).load(some)
        write(rows.select("path", F.col("modificationTime").alias("modified_at"), F.col("content").cast("string").alias("content")), 0)


def watch(spark: SparkSession, root: str, target: str, checkpoint: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE, per_trigger: int = 1000) -> StreamingQuery:
    """Indexes what is there and ends (available-now trigger); run it again, with the same globs, for what changed or went."""
    shared_dir(spark)
    refresh(spark, root, target, include, exclude)
    stream = changed_files(spark, root, include, exclude, per_trigger)
    return stream.writeStream.foreachBatch(upsert_annotations(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_state(target: str, keys: list[str], order: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the newest row of each key in a table bucketed by key; a batch rewrites the buckets it falls in."""

    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = fresh.select("bucket").distinct()
        old = _existing(batch.sparkSession, target)
        current = fresh.limit(0) if old is None else old.join(F.broadcast(touched), "bucket", "left_semi").select(*fresh.columns)
        _replace(upsert(current, fresh, keys, order).select(*fresh.columns), touched, target)

    return write


def event_windows(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and tumbling window under a watermark (an extra that streams make easy)."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
