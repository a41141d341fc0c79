"""Search by posting lists against a scan."""

import random

from srcatlas.operators import search


def test_equal_to_a_scan(spark, tmp_path):
    chance = random.Random(3)
    word = lambda n: "".join(chance.choice("abAÄ_é ") for _ in range(n))
    names = [(i, word(chance.randrange(0, 12))) for i in range(400)] + [(400, None), (401, "aab" * 2000), (402, "x"), (402, "x")]
    patterns = [(i, word(chance.randrange(0, 6))) for i in range(60)] + [(60, None), (61, "zzz"), (62, "aab" * 1999), (63, "abzz")]
    rows = spark.createDataFrame(names, "id long, name string")
    postings = search.index(rows)
    got = sorted((r["q"], r["id"]) for r in search.search(postings, rows, spark.createDataFrame(patterns, "q long, pattern string")).collect())
    scan = lambda p: sorted({i for i, n in names if n is not None and p.lower() in n.lower()})
    assert got == sorted((q, i) for q, p in patterns if p is not None for i in scan(p))
    path = str(tmp_path / "lists")
    search.write(postings, path)
    for pattern in ("", "a", "ÄB", "aba", "abaa", "zzz"):
        made = search.find(spark, path, rows, pattern)
        assert sorted({r["id"] for r in made.collect()}) == scan(pattern)
        if pattern:
            assert "gram" in made._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    assert search.search(search.index(rows.limit(0)), rows.limit(0), spark.createDataFrame(patterns, "q long, pattern string")).count() == 0


def test_names_and_postings_are_not_broadcast(spark):
    names = spark.range(0, 500).selectExpr("id", "concat('name ', id) as name")
    patterns = spark.createDataFrame([(1, "name 49"), (2, "e 3"), (3, "")], "q long, pattern string").cache()
    found = search.search(search.index(names), names, patterns)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.split("\n") if "BroadcastHashJoin" in line]
    # wanted pieces, which follow the patterns alone, may be
    assert all("LeftSemi" in line or "gram" in line for line in joins) and "SortMergeJoin [id" in plan and "ShuffledHashJoin [gram" in plan
    assert found.where("q = 3").count() == 500 and found.where("q = 1").count() == 11
