"""Modification rules: permissions, requirements, overlays, guardrails."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..schema import LOCK_LEVELS, MARKER

_M = re.escape(MARKER).replace("\\@", "@")

# Guardrail annotations and what follows them.
GUARDRAILS = {
    "style": r"\s+(\S+)(?:\s+(\S+))?",
    "framework": r"\s+([^\s@]+)(?:@(\S+))?(?:\s+(\S+))?",
    "requires": r"\s+(.+)",
    "forbids": r"\s+(.+)",
    "ai-readonly": r"(?:\s+reason:(.+))?",
    "ai-careful": r"\s+(.+)",
    "ai-ask": r"\s+(.+)",
    "ai-context": r"\s+(.+)",
    "ai-reference": r"\s+(.+)",
    "hack": r"\s+(.+)",
    "attempt-start": r"\s+id:(\S+)(?:\s+for:(\S+))?(?:\s+description:(.+))?",
    "checkpoint": r"\s+name:(\S+)(?:\s+hash:(\S+))?",
    "review-required": r"\s+(.+)",
    "tech-debt": r"\s+(.+)",
    "test-required": r"\s+(.+)",
}
LISTS = ("requires", "forbids", "review-required", "test-required")


def level_rank(level: Column) -> Column:
    """0 for the severest."""
    return F.array_position(F.array(*map(F.lit, LOCK_LEVELS)), level) - 1


def permission(level: Column, operation: Column, allowed: Column) -> Column:
    """denied, approval or allowed."""
    return (
        F.when(level == "frozen", "denied")
        .when((level == "restricted") & allowed.isNotNull() & ~F.array_contains(allowed, operation), "denied")
        .when(level.isin("restricted", "approval-required"), "approval")
        .otherwise("allowed")
    )


def requirements(approval: Column, tests: Column, docs: Column, maximum: Column, reviewers: Column) -> Column:
    """What a change needs, sorted."""
    many = F.concat(F.lit("max-lines:"), maximum.cast("string"))
    wanted = F.array(
        F.when(approval, "approval"), F.when(tests, "tests"), F.when(docs, "docs"), F.when(maximum.isNotNull(), many), F.when(reviewers, "review")
    )
    return F.array_sort(F.array_distinct(F.array_compact(wanted)))


def overlay(children: DataFrame, parents: DataFrame, key: str, fields: list[str], lists: list[str]) -> DataFrame:
    """Constraints in force: the child's fields win, lists add up."""
    up = parents.select(key, *[F.col(c).alias(f"up_{c}") for c in (*fields, *lists)])
    joined = children.join(up, key, "left")
    empty = F.array().cast("array<string>")
    return joined.select(
        *[c for c in children.columns if c not in (*fields, *lists)],
        *[F.coalesce(c, f"up_{c}").alias(c) for c in fields],
        *[F.concat(F.coalesce(f"up_{c}", empty), F.coalesce(c, empty)).alias(c) for c in lists],
    )


def check_report(constraints: DataFrame, shown: int = 10) -> DataFrame:
    """Files by level in order of severity, ``shown`` of each, and how many more there are."""
    counts = constraints.groupBy("level").agg(F.greatest(F.count("*") - shown, F.lit(0)).alias("more"))  # a row a level
    # only the first of each level leave their tasks
    listed = constraints.withColumn("at", F.row_number().over(Window.partitionBy("level").orderBy("path"))).where(F.col("at") <= shown)
    return listed.join(counts, "level").select(level_rank(F.col("level")).cast("long").alias("rank"), "level", F.col("at").cast("long").alias("at"), "path", "more")


def guardrails(lines: DataFrame) -> DataFrame:
    """path, line_no, kind, and up to three parts of every guardrail annotation; lists give a row an item."""
    hits = lines.where(F.col("text").contains(MARKER))
    found = []
    for kind, rest in GUARDRAILS.items():
        pattern = f"{_M}{kind}{rest}"
        groups = re.compile(pattern).groups
        part = lambda i, p=pattern, g=groups: blank_to_null(F.regexp_extract("text", p, i)) if i <= g else F.lit(None).cast("string")
        found.append(F.when(F.col("text").rlike(pattern), F.struct(F.lit(kind).alias("kind"), part(1).alias("one"), part(2).alias("two"), part(3).alias("three"))))
    rows = hits.select("path", "line_no", F.explode(F.array_compact(F.array(*found))).alias("g")).select("path", "line_no", "g.*")
    items = F.when(F.col("kind").isin(*LISTS), F.transform(F.split("one", ","), lambda v: F.trim(v))).otherwise(F.array("one"))
    return rows.select("path", "line_no", "kind", F.explode(items).alias("one"), "two", "three")


def enforce(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings on (path, content) under (path, kind, one): forbidden texts, read-only files, required actions."""
    joined = changes.join(rules, "path")
    finding = (
        F.when((F.col("kind") == "forbids") & F.col("content").contains(F.col("one")), F.struct(F.lit("violation").alias("what"), F.lit("error").alias("severity")))
        .when(F.col("kind") == "ai-readonly", F.struct(F.lit("violation").alias("what"), F.lit("error").alias("severity")))
        .when(F.col("kind") == "ai-careful", F.struct(F.lit("warning").alias("what"), F.lit("warning").alias("severity")))
        .when(F.col("kind") == "ai-ask", F.struct(F.lit("action").alias("what"), F.lit("info").alias("severity")))
        .when(F.col("kind").isin("review-required", "test-required"), F.struct(F.lit("action").alias("what"), F.lit("warning").alias("severity")))
    )
    return joined.withColumn("f", finding).where(F.col("f").isNotNull()).select("path", "kind", F.col("one").alias("rule"), "f.what", "f.severity")


def expired(hacks: DataFrame, as_of: str) -> DataFrame:
    """Hacks past their date."""
    return hacks.where(F.col("expires") < F.lit(as_of).cast("date"))
