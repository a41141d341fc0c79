"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise

#: Rounds after which something is wrong: each round at least halves the longest path.
ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); a component is its smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014).  Both
    steps aggregate with partial minima, so a node with very many neighbours is
    combined before the shuffle, and Spark may split its join.
    """
    held = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    before = None
    for _ in range(ROUNDS):
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = materialise(small.select("e.a", "e.b").where("a != b").distinct(), "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        forget(held.sparkSession, held)
        held = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    stars = held.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
