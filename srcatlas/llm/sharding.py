"""Two-pass external shuffle into shards (DataFrame functions only).

Pass one scatters whole records with seeded hashes: a rendezvous hash of
(id, shard) picks the shard, so one more shard takes records only into itself,
and a second hash spreads a shard evenly over buckets.  Pass two gathers one
bucket at a time, brings its records into an order of their own (by id, then
content) and shuffles it: Fisher-Yates, inside out, as a fold over the places.
Its draws are hashes of (seed, shard, bucket, place), so a slot depends on the
records and the seed alone, not on partitions, tasks or file layout.  The
shuffled buckets are written; a bucket begins where the earlier buckets of its
shard end, for which only the buckets' counts are summed.

A bucket holds about ``BUCKET_ROWS`` records or ``BUCKET_BYTES`` of text,
whichever is less: each shard has as many buckets as its own rows and bytes
need, so memory follows neither the table nor a hot id.  Of a row that repeats
more often than a ``COPIES_SHARE``-th of a bucket, one per task travels with its
count, and its numbered copies are dealt to buckets one by one.

Cases: a null text has size ``OVERHEAD`` and crc32 0 (empty bytes); a null id
is hashed like any value and its bucket also depends on the text, so many null
ids still spread over their shard's buckets; equal ids share a shard, as the law
asks, and are told apart by their texts; repeated rows are kept, each with its
own slot, however many; an empty table gives no rows; a text longer than a bucket is in a
bucket of its own size; further columns, of whatever names, are ignored by
``assign`` and kept by ``write_shards``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SHARDS = 40
OVERHEAD = 16
BUCKET_ROWS = 2048
BUCKET_BYTES = 8 << 20
#: Text that one task of the second pass gathers, in buckets.
TASK_BYTES = 32 << 20
#: A row with more than a sixteenth of a bucket in copies is dealt out copy by copy, so many to a step.
COPIES_SHARE = 16
STEP = 4096
#: Repeating rows whose hashes may be broadcast, 8 bytes each; beyond that a join finds them.
BROADCAST_COPIES = 100_000
SEED = 20240607


def best(key: Column, shards: int, seed: int = SEED) -> Column:
    """The largest of a key's hashes with all shards, and its shard: struct<h, s>."""
    return F.array_max(F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards)]))


def fisher_yates(n: Column, *seeds: Column) -> Column:
    """A uniform order of 0 .. n - 1 as array<int>, drawn from hashes of the seeds.

    Inside out: place i takes over a random earlier place's element (or its
    own), which moves to the end.
    """

    def step(order: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(*seeds, i), (i + 1).cast("long")).cast("int")
        swapped = F.concat(F.slice(order, F.lit(1), j), F.array(i), F.slice(order, j + 2, i - j - 1), F.array(F.get(order, j)))
        return F.when(j == i, F.array_append(order, i)).otherwise(swapped)

    places = F.filter(F.sequence(F.lit(0), n.cast("int")), lambda i: i < n)
    return F.aggregate(places, F.array().cast("array<int>"), step)


def shuffled(docs: DataFrame, record: Column, shards: int, seed: int, bucket_rows: int, bucket_bytes: int) -> DataFrame:
    """shard, slot, grown (the shard when there is one more) and the record of every row."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.col("doc_id")
    content = F.xxhash64(F.lit(seed + 1), key, raw)
    light = docs.select(best(key, shards, seed)["s"].alias("shard"), content.alias("content"), F.octet_length(raw).cast("long").alias("bytes"))
    counted = materialise(light.groupBy("shard", "content").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")), "counted")
    most = F.greatest(F.sum("n") / F.lit(bucket_rows), F.sum("bytes") / F.lit(bucket_bytes))
    # a row a shard
    buckets = F.broadcast(counted.groupBy("shard").agg(F.greatest(F.ceil(most), F.lit(1)).alias("buckets")))
    copied = counted.where(F.col("n") > max(1, bucket_rows // COPIES_SHARE)).select("content").distinct()
    size = counted.agg(F.sum("bytes").alias("bytes")).first()["bytes"] or 0
    copied = F.broadcast(copied) if copied.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES else materialise(copied, "copied")

    # the hashes of the first ``shards`` shards decide; the new shard wins only with a larger one
    found = F.struct(best(key, shards, seed).alias("b"), F.xxhash64(F.lit(seed), F.lit(shards), key).alias("new"))
    placed = docs.select(found.alias("f"), content.alias("content"), key.alias("id"), record.alias("record")).select(
        F.col("f.b.s").alias("shard"), "id", "content", F.when(F.col("f.new") > F.col("f.b.h"), F.lit(shards)).otherwise(F.col("f.b.s")).alias("grown"), "record"
    )

    def dealt(rows: DataFrame, place: Column) -> DataFrame:
        bucket = F.pmod(place, F.col("buckets")).cast("int")
        return rows.join(buckets, "shard").select("shard", bucket.alias("bucket"), F.struct("id", "content", "grown", "record").alias("r"))

    single = dealt(placed.join(copied, "content", "left_anti"), F.col("content"))
    steps = placed.join(copied, "content", "left_semi").groupBy("shard", "id", "content", "grown", "record").agg(F.count("*").alias("n"))
    steps = steps.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(STEP).cast("long")))).repartition("content", "first")
    copies = steps.withColumn("copy", F.explode(F.sequence("first", F.least(F.col("first") + STEP, F.col("n")) - 1)))
    placed = single.unionByName(dealt(copies, F.xxhash64("content", "copy")))

    # pass one: whole buckets travel, so many of them to a task as fit its memory
    scattered = placed.repartition(max(1, math.ceil(size / TASK_BYTES)), "shard", "bucket")
    # pass two
    gathered = scattered.groupBy("shard", "bucket").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    order = fisher_yates(F.size("rs"), F.lit(seed + 2), F.col("shard"), F.col("bucket"))
    done = materialise(gathered.select("shard", "bucket", F.size("rs").alias("n"), F.transform(order, lambda i: F.get("rs", i)).alias("rs")), "buckets")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = done.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("begin"))
    # a row a bucket, so one for about every 8 MB of text or 2048 rows; joined otherwise, whole buckets would travel again
    return done.drop("n").join(F.broadcast(begins), ["shard", "bucket"]).select("shard", "begin", F.posexplode("rs").alias("at", "r")).select(
        "shard", (F.col("begin") + F.col("at")).cast("long").alias("slot"), F.col("r.grown").alias("grown"), F.col("r.record").alias("record")
    )


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    record = F.struct(F.col("doc_id"), F.col("text"))
    raw = F.coalesce(F.col("record.text"), F.lit("")).cast("binary")
    return shuffled(docs, record, shards, seed, bucket_rows, bucket_bytes).select(
        F.col("record.doc_id").alias("doc_id"),
        (F.octet_length(raw) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        F.col("grown").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes whole records with their slots, one folder per shard; each file holds buckets in the order of their slots."""
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    placed = shuffled(docs, record, shards, seed, bucket_rows, bucket_bytes).select("shard", "slot", "record")
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
