"""Substring search over names by posting lists of their pieces of up to three letters.

A name is found by the pieces of a pattern: those in the fewest names come
first, their lists are intersected, and what is left is tested exactly, letter
case aside.  Patterns of one or two letters have lists of their own, and the
empty pattern, which every name holds, has the list of all names.  Null names
and patterns match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Letters of the longest pieces, and lists that are intersected for a pattern.
LONGEST, LISTS = 3, 3


def _pieces(text: Column, n: int) -> Column:
    """The pieces of n letters of a text."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def grams(name: Column) -> Column:
    """All distinct pieces of a name, the empty one among them."""
    low = F.lower(name)
    return F.array_distinct(F.concat(F.array(F.lit("")), *[_pieces(low, n) for n in range(1, LONGEST + 1)]))


def asked(pattern: Column) -> Column:
    """The pieces whose lists can find a pattern."""
    low = F.lower(pattern)
    return F.when(F.length(low) < LONGEST, F.array(low)).otherwise(F.array_distinct(_pieces(low, LONGEST)))


def index(names: DataFrame) -> DataFrame:
    """gram and id of every piece of (id, name)."""
    return names.where("name is not null").select(F.explode(grams(F.col("name"))).alias("gram"), "id").distinct()


def write(postings: DataFrame, path: str) -> None:
    """Stores lists in the order of their pieces, so that a reader skips the row groups of others."""
    postings.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.mode("overwrite").parquet(path)


def search(postings: DataFrame, names: DataFrame, patterns: DataFrame) -> DataFrame:
    """q, id and name of every name (id, name) that holds a pattern (q, pattern)."""
    wanted = patterns.where("pattern is not null").select("q", "pattern", F.explode(asked(F.col("pattern"))).alias("gram"))
    used = postings.join(wanted.select("gram").distinct(), "gram", "left_semi")
    sizes = used.groupBy("gram").agg(F.count("*").alias("n"))
    rare = Window.partitionBy("q", "pattern").orderBy("n", "gram")
    # a piece without a list has no name, and with it the pattern
    sized = wanted.join(sizes, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = sized.withColumn("rank", F.row_number().over(rare)).where(F.col("rank") <= LISTS)
    lists = first.withColumn("lists", F.count("*").over(Window.partitionBy("q", "pattern"))).select("q", "pattern", "gram", "lists")
    # built from the patterns' lists: postings look as small as the names they are made of, and would be sent whole
    found = lists.hint("shuffle_hash").join(used, "gram").groupBy("q", "pattern", "lists", "id").agg(F.count("*").alias("n")).where("n = lists")
    # names are as many as the caller has, and few bytes on disk say little of their rows: they are never sent through the driver
    tested = found.select("q", "pattern", "id").join(names.select("id", "name").hint("merge"), "id").where(F.lower("name").contains(F.lower("pattern")))
    return tested.select("q", "id", "name").distinct()


def find(spark: SparkSession, path: str, names: DataFrame, pattern: str) -> DataFrame:
    """id and name of the names that hold one pattern; only its pieces are read from stored lists."""
    low = pattern.lower()
    pieces = [low] if len(low) < LONGEST else sorted({low[i : i + LONGEST] for i in range(len(low) - LONGEST + 1)})
    held = spark.read.parquet(path).where(F.col("gram").isin(*pieces)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(pieces))
    return held.select("id").join(names.select("id", "name"), "id").where(F.lower("name").contains(low))
