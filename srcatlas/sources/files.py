"""Source trees as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import language, selected
from ..schema import EXCLUDE, INCLUDE

COLUMNS = ("path", "modified_at", "length", "language", "content")


def scan(spark: SparkSession, root: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE, max_bytes: int | None = None, content: bool = True) -> DataFrame:
    """Files below ``root``: path below it, modification time, length, language and text.

    The listing alone filters by glob, and by size where ``max_bytes`` is given:
    without ``content`` Spark reads no file.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # stored paths carry a scheme that the root may lack
    base = root.split(":", 1)[-1].rstrip("/").replace("//", "/") + "/"
    full = F.regexp_replace("path", "^[a-zA-Z]+:/*", "/")
    rows = found.withColumn("full", full).withColumn("rel", F.when(F.col("full").startswith(base), F.substring("full", len(base) + 1, 1 << 30)).otherwise(F.col("full")))
    kept = rows.where(selected(F.col("rel"), include, exclude))
    kept = kept if max_bytes is None else kept.where(F.col("length") <= max_bytes)
    columns = [F.col("rel").alias("path"), F.col("modificationTime").alias("modified_at"), "length", language(F.col("rel")).alias("language")]
    if content:
        columns.append(F.col("content").cast("string").alias("content"))
    return kept.select(*columns)


def to_annotate(listing: DataFrame, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE, wanted: str | None = None) -> DataFrame:
    """The files that annotating looks at: their full path matches an include glob (none if there is none), no exclude glob, and ``wanted``."""
    kept = listing.where(selected(F.col("path"), include, exclude)) if include else listing.where(F.lit(False))
    return kept.where(selected(F.col("path"), (wanted,))) if wanted else kept


def probe(files: DataFrame) -> DataFrame:
    """Files by language, most first, and which build files there are."""
    marks = {"package_json": "package.json", "cargo_toml": "Cargo.toml", "pyproject": "pyproject.toml", "go_mod": "go.mod"}
    found = files.agg(*[F.max(F.col("path").rlike(rf"(^|/){name.replace('.', chr(92) + '.')}$")).alias(column) for column, name in marks.items()])
    counted = files.where(F.col("language").isNotNull()).groupBy("language").agg(F.count("*").alias("files"))
    return counted.join(F.broadcast(found)).orderBy(F.desc("files"), "language")
