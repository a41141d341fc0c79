"""Version-control facts: history per file, blame per line, ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMMITS_PER_FILE = 100


def newest(commits: DataFrame, most: int = COMMITS_PER_FILE) -> DataFrame:
    """At most ``most`` commits of each path, newest first; 0 keeps all."""
    if not most:
        return commits
    ranked = commits.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("ts"), "commit_id")))
    return ranked.where(F.col("rank") <= most).drop("rank")


def summary(commits: DataFrame) -> DataFrame:
    """Commits, authors, first and last commit, and changed lines of every path."""
    return commits.groupBy("path").agg(
        F.count("*").alias("commits"),
        F.array_sort(F.collect_set("author")).alias("authors"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max_by("commit_id", F.struct("ts", "commit_id")).alias("last_commit"),
        F.max_by("author", F.struct("ts", "commit_id")).alias("last_author"),
        F.sum("added").alias("added"),
        F.sum("removed").alias("removed"),
    )


def enrich(files: DataFrame, history: DataFrame) -> DataFrame:
    """Files with their history; paths match without a leading ``./``."""
    clean = lambda c: F.regexp_replace(c, r"^\./", "")
    keyed = files.withColumn("k", clean("path"))
    return keyed.join(history.withColumn("k", clean("path")).drop("path"), "k", "left").drop("k")


def age_days(ts: Column, as_of: str) -> Column:
    """Whole days before ``as_of``, never negative."""
    seconds = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))
    return F.greatest(F.floor(seconds / 86400), F.lit(0)).cast("long")


def symbol_blame(ranges: DataFrame, blame: DataFrame, as_of: str) -> DataFrame:
    """Per symbol: its lines' newest change, authors and ages.

    A range join whose equality on the path keeps it a hash or merge join.
    """
    inside = (ranges["path"] == blame["path"]) & blame["line_no"].between(ranges["line_start"], ranges["line_end"])
    joined = ranges.join(blame, inside).select(ranges["path"], ranges["name"], blame["line_no"], blame["author"], blame["ts"])
    made = joined.groupBy("path", "name").agg(
        F.countDistinct("line_no").alias("lines"),
        F.max("ts").alias("last_ts"),
        F.min("ts").alias("first_ts"),
        F.array_sort(F.collect_set("author")).alias("authors"),
    )
    return made.select("path", "name", "lines", "authors", age_days(F.col("last_ts"), as_of).alias("newest_days"), age_days(F.col("first_ts"), as_of).alias("oldest_days"))
