"""State machines against a plain walk over each id's events, in batch and as a stream."""

import random
from datetime import datetime, timedelta

import numpy as np

from srcatlas.operators import attempts, machines

SCHEMA = "id string, event string, ts timestamp, seq long"
EVENTS = [*attempts.ATTEMPT.events, "odd", None]


def _log(n, seed, ids):
    chance = random.Random(seed)
    zero = datetime(2024, 1, 1)
    return [(chance.choice(ids), chance.choice(EVENTS), zero + timedelta(seconds=chance.randrange(n)), i) for i in range(n)]


def _walked(log, machine):
    state, out = {}, []
    for who, event, ts, seq in sorted(log, key=lambda r: (r[2], r[3], r[1] or "")):
        before = state.get(who, machine.states[0])
        known = event in machine.events
        after, verdict = machine.moves.get((before, event), (before, "forbidden" if known else "unknown"))
        state[who] = after
        out.append((who, event, ts, seq, before, after, verdict))
    return sorted(out, key=lambda r: r[3])


def _rows(made):
    return sorted((tuple(r) for r in made.collect()), key=lambda r: r[3])


def test_composition_by_doubling():
    chance = np.random.default_rng(1)
    maps = chance.integers(0, 4, (200, 4))
    first = np.repeat([0, 7, 8, 150], [7, 1, 142, 50])
    made = machines.running(maps, first)
    for i in range(200):
        for s in range(4):
            at = s
            for j in range(first[i], i + 1):
                at = maps[j][at]
            assert made[i][s] == at


def test_batch_equals_walk(spark):
    # one id holds a third of all rows and lies in many ranges; small batches cut ids as well
    log = _log(1500, 1, ["hot"] * 4 + [f"i{i}" for i in range(6)] + [None, ""])
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for parts, size in (("1", "10000"), ("7", "50")):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert _rows(machines.run(spark.createDataFrame(log, SCHEMA), attempts.ATTEMPT)) == _walked(log, attempts.ATTEMPT)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert machines.run(spark.createDataFrame([], SCHEMA), attempts.ATTEMPT).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    log = sorted(_log(300, 2, ["a", "b", "c", None]), key=lambda r: (r[2], r[3]))
    source, out, kept = (str(tmp_path / p) for p in ("in", "out", "log"))
    for half in (log[:150], log[150:]):
        spark.createDataFrame(half, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        made = machines.stream(spark.readStream.schema(SCHEMA).parquet(source), attempts.ATTEMPT)
        query = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", kept).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
    assert _rows(spark.read.parquet(out)) == _walked(log, attempts.ATTEMPT)
