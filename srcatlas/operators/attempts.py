"""Attempts and checkpoints as an event log and the state it adds up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MAX_CONTENT_BYTES
from .machines import Machine, run

#: Events after which an attempt leaves the list of open ones.
CLOSING = ("verified", "reverted")


def state(events: DataFrame) -> DataFrame:
    """The last event of every open attempt in (id, status, ts, seq): closed ones are gone, failed ones stay."""
    last = events.groupBy("id").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.count("*").alias("events")
    )
    return last.where(~F.col("status").isin(*CLOSING))


def history(events: DataFrame) -> DataFrame:
    """Ended attempts: one row per failure, verification or revert, with the time since the attempt's previous event."""
    order = Window.partitionBy("id").orderBy("ts", "seq")
    timed = events.withColumn("started_at", F.coalesce(F.lag("ts").over(order), "ts"))
    return timed.where(F.col("status").isin("failed", *CLOSING)).select("id", "status", "started_at", F.col("ts").alias("ended_at"))


def latest_active(events: DataFrame) -> DataFrame:
    """The id of the newest attempt that is still active."""
    return state(events).where("status = 'active'").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


def stored(content: Column) -> Column:
    """A file's content if it is small enough to keep for a revert."""
    return F.when(F.octet_length(content) <= MAX_CONTENT_BYTES, content)


def modification(rows: DataFrame) -> DataFrame:
    """path, hashes before and after, and the kept content, of (path, before, after)."""
    return rows.select("path", F.md5(F.col("before").cast("binary")).alias("original_hash"), F.md5(F.col("after").cast("binary")).alias("modified_hash"), stored(F.col("before")).alias("original_content"))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows by key, the change of the highest ``order`` over what was there."""
    ranked = current.withColumn("__order", F.lit(None).cast(changes.schema[order].dataType)).unionByName(changes.withColumn("__order", F.col(order)), allowMissingColumns=True)
    newest = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("__order"))
    return ranked.withColumn("__at", F.row_number().over(newest)).where("__at = 1").drop("__at", "__order")


def restore_plan(checkpoint_files: DataFrame, current: DataFrame) -> DataFrame:
    """Files of a checkpoint that differ from the current ones: path and what to write."""
    joined = checkpoint_files.join(current.select("path", F.md5(F.col("content").cast("binary")).alias("now")), "path", "left")
    return joined.where(F.col("now").isNull() | (F.col("now") != F.col("hash"))).select("path", "content", F.col("content").isNotNull().alias("restorable"))


def debug_sessions(events: DataFrame) -> DataFrame:
    """Sessions with their attempts, keeps and reverts, and the state the last event left."""
    return events.groupBy("session").agg(
        F.count("*").alias("attempts"), F.count_if(F.col("result") == "success").alias("kept"), F.count_if(F.col("result") == "failure").alias("reverted"), F.max_by("status", F.struct("ts", "seq")).alias("status")
    )


#: An attempt: started anew at any time, changed and reverted only while it is open; ending one that is not open has no effect.
ATTEMPT = Machine(
    ("absent", "active", "failed"),
    {
        ("absent", "start"): ("active", "done"), ("active", "start"): ("active", "done"), ("failed", "start"): ("active", "done"),
        ("active", "modify"): ("active", "done"), ("failed", "modify"): ("failed", "done"),
        ("absent", "fail"): ("absent", "ignored"), ("active", "fail"): ("failed", "done"), ("failed", "fail"): ("failed", "done"),
        ("absent", "verify"): ("absent", "ignored"), ("active", "verify"): ("absent", "done"), ("failed", "verify"): ("absent", "done"),
        ("active", "revert"): ("absent", "done"), ("failed", "revert"): ("absent", "done"),
    },
)
#: One try of a debug session.  A success keeps it; a revert drops it for good, whatever is recorded later.
TRY = Machine(
    ("absent", "open", "kept", "reverted"),
    {
        ("absent", "add"): ("open", "done"),
        ("absent", "success"): ("absent", "ignored"), ("open", "success"): ("kept", "done"), ("kept", "success"): ("kept", "done"), ("reverted", "success"): ("reverted", "done"),
        ("absent", "failure"): ("absent", "ignored"), ("open", "failure"): ("open", "done"), ("kept", "failure"): ("kept", "done"), ("reverted", "failure"): ("reverted", "done"),
        ("absent", "partial"): ("absent", "ignored"), ("open", "partial"): ("open", "done"), ("kept", "partial"): ("kept", "done"), ("reverted", "partial"): ("reverted", "done"),
        ("absent", "revert"): ("absent", "ignored"), ("open", "revert"): ("reverted", "done"), ("kept", "revert"): ("reverted", "done"), ("reverted", "revert"): ("reverted", "done"),
    },
)


def tries(events: DataFrame) -> DataFrame:
    """session, attempts, kept and reverted: tries by the state that their last event left; an id is ``session/attempt``."""
    ended = run(events, TRY).groupBy("id").agg(F.max_by("after", F.struct("ts", "seq", "event")).alias("state"))
    return ended.groupBy(F.regexp_replace("id", "/[^/]*$", "").alias("session")).agg(
        F.count_if(F.col("state") != "absent").alias("attempts"), F.count_if(F.col("state") == "kept").alias("kept"), F.count_if(F.col("state") == "reverted").alias("reverted")
    )
