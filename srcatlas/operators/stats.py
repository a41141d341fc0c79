"""Counts and rollups over files, symbols and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import share
from ..schema import LOCK_LEVELS, LOW_CONFIDENCE, ORIGINS


def totals(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files, symbols, lines, and the per cent of symbols with a summary."""
    left = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))
    right = symbols.agg(F.count("*").alias("symbols"), F.count("summary").alias("summed"))
    # two single rows
    return left.join(F.broadcast(right)).select("files", "symbols", "lines", share(F.col("summed"), F.col("symbols")).alias("coverage"))


def languages(files: DataFrame) -> DataFrame:
    """Files and lines by language, and each one's share of the files."""
    counted = files.groupBy("language").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))
    total = counted.agg(F.sum("files").alias("total"))
    return counted.join(F.broadcast(total)).select("language", "files", "lines", share(F.col("files"), F.col("total")).alias("share"))


def domains(files: DataFrame) -> DataFrame:
    """Domain to its files; repeated mentions in one file count once."""
    spread = files.select("path", F.explode(F.array_distinct("domains")).alias("domain"))
    return spread.groupBy("domain").agg(F.count("*").alias("files"), F.min("path").alias("first_file"))


def lock_row(files: DataFrame) -> DataFrame:
    """A constraint row for files with a lock or a hint; unknown levels are normal."""
    level = F.when(F.col("lock").isin(*LOCK_LEVELS), F.col("lock")).otherwise("normal")
    held = files.where(F.col("lock").isNotNull() | (F.size("ai_hints") > 0))
    return held.select(
        "path",
        level.alias("level"),
        F.col("lock_directive").alias("directive"),
        (level == "approval-required").alias("requires_approval"),
        (level == "tests-required").alias("requires_tests"),
        (level == "docs-required").alias("requires_docs"),
    )


def lock_levels(constraints: DataFrame) -> DataFrame:
    return constraints.groupBy("level").agg(F.count("*").alias("files"))


def domain_locks(files: DataFrame, levels: tuple[str, ...] = ("frozen", "restricted")) -> DataFrame:
    """Protected files per domain."""
    rows = files.select(F.explode(F.array_distinct("domains")).alias("domain"), "lock")
    return rows.groupBy("domain").agg(
        F.count("*").alias("files"), *[F.count_if(F.col("lock") == x).alias(x.replace("-", "_")) for x in levels]
    )


def provenance_stats(rows: DataFrame) -> DataFrame:
    """Totals, counts by origin, reviews, and the mean confidence of each origin: one row."""
    return rows.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("source") == o).alias(f"n_{o}") for o in ORIGINS],
        F.count_if("needs_review").alias("needs_review"),
        F.count_if("reviewed").alias("reviewed"),
        *[F.avg(F.when(F.col("source") == o, F.col("confidence"))).alias(f"avg_{o}") for o in ORIGINS],
    )


def provenance_report(rows: DataFrame) -> DataFrame:
    """Count, share of all and mean confidence by origin."""
    counted = rows.groupBy("source").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total)).select("source", "n", share(F.col("n"), F.col("total")).alias("share"), "confidence")


def low_confidence(rows: DataFrame, below: float = LOW_CONFIDENCE, most: int | None = None) -> DataFrame:
    """Annotations below a confidence, least first; ``most`` for a report."""
    found = rows.where(F.col("confidence") < below)
    return found.orderBy("confidence", "target", "key").limit(most) if most else found


def project_state(constraints: DataFrame, hacks: DataFrame, sessions: DataFrame, files: DataFrame, as_of: str) -> DataFrame:
    """One row of counters for section conditions; ``as_of`` makes expiry reproducible."""
    level = lambda x: F.count_if(F.col("level") == x)
    one = constraints.agg(
        *[level(x).alias(x.replace("-", "_")) for x in ("frozen", "restricted", "approval-required", "tests-required", "docs-required")]
    ).withColumn("protected", F.col("frozen") + F.col("restricted"))
    two = hacks.agg(F.count("*").alias("hacks"), F.count_if(F.col("expires") < F.lit(as_of).cast("date")).alias("expired"))
    three = sessions.agg(F.count_if(F.col("status") == "active").alias("active_attempts"))
    four = files.select(F.explode("domains").alias("d")).agg(F.countDistinct("d").alias("domains"))
    return one.join(F.broadcast(two)).join(F.broadcast(three)).join(F.broadcast(four))


def bridge_stats(files: DataFrame) -> DataFrame:
    """Explicit, converted and merged counts by documentation format, and over all (null format)."""
    made = files.groupingSets([("detected_format",), ()], "detected_format").agg(
        F.sum("explicit_count").alias("explicit"), F.sum("converted_count").alias("converted"), F.sum("merged_count").alias("merged"), F.grouping("detected_format").alias("g")
    )
    return made.where((F.col("g") == 1) | (F.col("detected_format").isNotNull() & (F.col("converted") + F.col("merged") > 0))).select(
        F.when(F.col("g") == 1, "all").otherwise(F.col("detected_format")).alias("format"), "explicit", "converted", "merged", (F.col("converted") + F.col("merged")).alias("documented")
    )
