"""Point lookups, searches and small reports over stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import confidence as confidence_filter
from ..functions.paths import normalize


def symbol(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("name") == name)


def search(symbols: DataFrame, text: str) -> DataFrame:
    """Symbols whose name holds ``text``, in any case."""
    return symbols.where(F.lower("name").contains(text.lower()))


def file(files: DataFrame, path: str) -> DataFrame:
    """A file by its path in any spelling: exact before normal forms."""
    wanted = F.lit(path)
    rank = F.when(F.col("path") == wanted, 0).when(F.col("path") == normalize(wanted), 1).when(normalize(F.col("path")) == normalize(wanted), 2)
    return files.withColumn("rank", rank).where(F.col("rank").isNotNull()).orderBy("rank", "path").limit(1).drop("rank")


def in_layer(files: DataFrame, layer: str) -> DataFrame:
    return files.where(F.col("layer") == layer)


def in_domain(files: DataFrame, domain: str) -> DataFrame:
    return files.where(F.array_contains("domains", domain))


def first_domain(files: DataFrame) -> DataFrame:
    """A file's first domain by name."""
    return files.select("path", F.explode("domains").alias("domain")).groupBy("path").agg(F.min("domain").alias("domain"))


def exported_symbols(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Exports with the symbols of that name; exports without one stay."""
    names = files.select("path", F.explode("exports").alias("name"))
    known = symbols.select("name", F.col("path").alias("defined_in"), "type")
    return names.join(known, "name", "left").select("path", "name", "defined_in", "type")


def with_constraints(files: DataFrame, constraints: DataFrame) -> DataFrame:
    """Files with their constraint; paths match in their normal form."""
    held = constraints.withColumn("k", normalize(F.col("path"))).drop("path")
    return files.withColumn("k", normalize(F.col("path"))).join(held, "k", "left").drop("k")


def variables_of(variables: DataFrame, kind: str | None = None, text: str | None = None) -> DataFrame:
    """Variables of a type, or with a text in their value or description."""
    found = variables
    if kind:
        found = found.where(F.col("type") == kind)
    if text:
        low = text.lower()
        found = found.where(F.lower("value").contains(low) | F.lower(F.coalesce("description", F.lit(""))).contains(low))
    return found


def needs_review(source: str | None = None, confidence: str | None = None) -> Column:
    """Unreviewed annotations that need it; an unknown confidence passes any filter."""
    keep = ~F.col("reviewed") & F.col("needs_review")
    if source:
        keep = keep & (F.col("source") == source)
    if confidence:
        keep = keep & (F.col("confidence").isNull() | confidence_filter(confidence, F.col("confidence")))
    return keep


def review_queue(rows: DataFrame, source: str | None = None, confidence: str | None = None) -> DataFrame:
    """What to review, least certain first."""
    found = rows.where(needs_review(source, confidence))
    return found.orderBy(F.coalesce("confidence", F.lit(1.0)), "target", "key")


def mark_reviewed(rows: DataFrame, matching: Column) -> DataFrame:
    """The same rows; matching ones that need it are reviewed."""
    hit = matching & ~F.col("reviewed")
    return rows.withColumn("needs_review", F.when(hit, False).otherwise(F.col("needs_review"))).withColumn("reviewed", F.when(hit, True).otherwise(F.col("reviewed")))


def issues_below(issues: DataFrame, prefix: str) -> DataFrame:
    return issues.where(F.col("path").startswith(prefix)).orderBy("path", "line_no")
