import zlib
from collections import Counter

from pyspark.sql import functions as F

from srcatlas.llm import sharding


def facts(rows):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"], r["shard"], r["slot"], r["grown_shard"]) for r in rows)


def test_slots_are_gapless_and_sizes_right(docs):
    rows = [(i, f"text {i % 5}") for i in range(500)]
    out = sharding.assign(docs(rows), shards=7, bucket_rows=16).collect()
    assert len(out) == 500
    for shard in range(7):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))
    for r in out:
        raw = f"text {r['doc_id'] % 5}".encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))


def test_one_more_shard_takes_only_into_itself(docs):
    rows = docs([(i, "t") for i in range(400)])
    old = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.assign(rows, shards=5).collect()}
    new = {r["doc_id"]: r["shard"] for r in sharding.assign(rows, shards=6).collect()}
    assert all(new[i] == grown and (grown == shard or grown == 5) for i, (shard, grown) in old.items())
    assert any(grown == 5 for _, grown in old.values())


def test_a_shard_is_shuffled_and_repeatable(docs):
    rows = docs([(i, "t") for i in range(2000)])
    one = sharding.assign(rows, shards=1, bucket_rows=4096).orderBy("slot").collect()
    two = sharding.assign(rows.repartition(3), shards=1, bucket_rows=4096).orderBy("slot").collect()
    order = [r["doc_id"] for r in one]
    assert order == [r["doc_id"] for r in two]
    moved = sum(a > b for a, b in zip(order, order[1:], strict=False))
    assert 800 < moved < 1200


def test_slots_do_not_depend_on_the_layout(spark, docs):
    rows = [(i if i % 50 else None, f"text {i % 70}") for i in range(3000)]
    found, kept = [], {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for parts in (4, 7, 16):
            for adaptive in ("true", "false"):
                spark.conf.set("spark.sql.adaptive.enabled", adaptive)
                spark.conf.set("spark.sql.shuffle.partitions", str(parts))
                found.append(facts(sharding.assign(docs(rows).repartition(parts), shards=6, bucket_rows=64).collect()))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert all(f == found[0] for f in found)


def plain(rows, seed, bucket_rows, hashes):
    """The same two passes in plain Python, with Spark's hashes looked up."""
    held, sizes = {}, Counter(shard for _, (shard, _, _) in rows)
    for row, (shard, grown, content) in rows:
        held.setdefault(shard, {}).setdefault(content % -(-sizes[shard] // bucket_rows), []).append((row[0], content, grown, row[1]))
    out = []
    for shard, parts in held.items():
        begin = 0
        for bucket in sorted(parts):
            records, order = sorted(parts[bucket]), []
            for i in range(len(records)):
                j = hashes(seed + 2, shard, bucket, i) % (i + 1)
                order.append(i)
                order[j], order[i] = order[i], order[j]
            out += [(records[k][0], shard, begin + at, records[k][2]) for at, k in enumerate(order)]
            begin += len(records)
    return sorted(out)


def test_against_a_plain_shuffle(spark, docs):
    rows, shards, seed = [(i, f"t{i % 30}") for i in range(400)], 5, sharding.SEED
    frame = docs(rows)
    key, raw = F.col("doc_id"), F.col("text").cast("binary")
    scores = [F.xxhash64(F.lit(seed), F.lit(s), key).alias(f"h{s}") for s in range(shards + 1)]
    placed = []
    for r in frame.select("doc_id", "text", F.xxhash64(F.lit(seed + 1), key, raw).alias("content"), *scores).collect():
        best = max(range(shards), key=lambda s: (r[f"h{s}"], s))
        placed.append(((r["doc_id"], r["text"]), (best, shards if r[f"h{shards}"] > r[f"h{best}"] else best, r["content"])))
    buckets = 8
    draws = spark.range(shards).crossJoin(spark.range(buckets).toDF("b")).crossJoin(spark.range(80).toDF("i"))
    seeds = (F.lit(seed + 2), F.col("id").cast("int"), F.col("b").cast("int"), F.col("i").cast("int"))
    known = {(r[0], r[1], r[2]): r[3] for r in draws.select("id", "b", "i", F.xxhash64(*seeds)).collect()}
    expected = plain(placed, seed, 20, lambda s, shard, bucket, i: known[shard, bucket, i])
    got = sharding.assign(frame, shards=shards, bucket_rows=20).collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"], r["grown_shard"]) for r in got) == expected


def test_orders_are_uniform(spark):
    """All six orders of three places come up equally often."""
    drawn = spark.range(6000).select(sharding.fisher_yates(F.lit(3), F.col("id")).alias("o")).groupBy("o").count().collect()
    assert len(drawn) == 6 and all(850 < r["count"] < 1150 for r in drawn)


def test_nulls_repeats_and_empty_tables(docs):
    out = sharding.assign(docs([(None, None), (None, None), (3, ""), (3, ""), (4, "x" * 100_000)])).collect()
    assert len(out) == 5
    assert sorted(r["size"] for r in out) == [16, 16, 16, 16, 100_016]
    assert sharding.assign(docs([])).count() == 0


def test_written_shards_hold_every_row(spark, docs, tmp_path):
    sharding.write_shards(docs([(i, f"t{i}") for i in range(100)]), str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["doc_id"] for r in back.select("record.doc_id").collect()) == list(range(100))
    rows = docs([(i, f"t{i}") for i in range(100)])
    assert back.select("record.*").columns == rows.columns
    written = {r[0]: (r[1], r[2]) for r in back.select("record.doc_id", "shard", "slot").collect()}
    assert written == {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign(rows, shards=4).collect()}


def test_a_long_text_and_clashing_columns(docs):
    frame = docs([(i, "x" * (5_000_000 if i == 3 else 10)) for i in range(20)]).selectExpr("*", "1 as shard", "2 as slot", "3 as r", "4 as record", "5 as content")
    out = sharding.assign(frame, shards=2, bucket_bytes=1 << 20).collect()
    assert sorted(r["size"] for r in out) == [26] * 19 + [5_000_016]
    for shard in (0, 1):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))


def test_equal_rows_fill_no_bucket(spark, docs, monkeypatch):
    """Copies keep to the bound of a bucket, take every slot once, and cost as much as other rows."""
    rows = [(1, "again and again")] * 20_000 + [(i, f"t{i}") for i in range(2000)]
    frame = docs(rows).repartition(8)
    for most in (100, 0):
        monkeypatch.setattr(sharding, "BROADCAST_COPIES", most)
        out = sharding.assign(frame, shards=3, bucket_rows=256)
        found = out.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("slots")).collect()
        assert sum(r["n"] for r in found) == 22_000 and all((r["low"], r["high"], r["slots"]) == (0, r["n"] - 1, r["n"]) for r in found)
        assert out.where("doc_id = 1 and size = 31").count() == 20_000
        first = facts(out.collect()) if most else first
    assert facts(out.collect()) == first


def test_a_hot_id_has_buckets_of_its_own(docs, monkeypatch):
    plain = sharding.fisher_yates
    monkeypatch.setattr(sharding, "fisher_yates", lambda n, *seeds: plain(F.when(n > 400, F.raise_error(F.lit("a bucket above its bound"))).otherwise(n), *seeds))
    out = sharding.assign(docs([(None, f"text {i}") for i in range(5000)]), shards=10, bucket_rows=256).collect()
    assert sorted(r["slot"] for r in out) == list(range(5000))


def test_buckets_travel_once(spark):
    docs = spark.range(0, 3000).selectExpr("id as doc_id", "repeat(concat('w', id), 20) as text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sharding.assign(docs, bucket_rows=64)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
