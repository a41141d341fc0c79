"""Tables as the text that a console shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_name
from ..schema import MARKER

# Branches of a tree, with and without line drawing, and what types are called.
BRANCH, LAST, PLAIN_BRANCH, PLAIN_LAST = "\u251c\u2500", "\u2514\u2500", "|-", "`-"
TYPES = {"function": "fn", "interface": "iface"}


def symbol_ref(name: Column, kind: Column, start: Column, end: Column | None = None) -> Column:
    """``name (type:line)`` or ``name (type:from-to)``."""
    shown = F.when(F.lit(False), F.lit(""))
    for k, v in TYPES.items():
        shown = shown.when(kind == k, v)
    at = start.cast("string") if end is None else F.concat_ws("-", start.cast("string"), end.cast("string"))
    return F.concat(name, F.lit(" ("), shown.otherwise(kind), F.lit(":"), at, F.lit(")"))


def file_trees(files: DataFrame, symbols: DataFrame, plain: bool = False) -> DataFrame:
    """path and text of every file: its name and level, its purpose, and a branch for each symbol in line order.

    ``files``: path, level, purpose; ``symbols``: path, name, type, line, frozen.
    """
    branch, last = (PLAIN_BRANCH, PLAIN_LAST) if plain else (BRANCH, LAST)
    marked = F.concat("name", F.lit(" ("), "type", F.lit(":"), F.col("line").cast("string"), F.lit(")"), F.when(F.coalesce("frozen", F.lit(False)), " [frozen]").otherwise(""))
    held = symbols.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "name", marked.alias("t")))).alias("s"))
    joined = files.join(held, "path", "left")
    head = F.concat(file_name(F.col("path")), F.coalesce(F.concat(F.lit(" ("), "level", F.lit(")")), F.lit("")))
    lines = F.transform("s", lambda x, i: F.concat(F.lit("  "), F.when(i == F.size("s") - 1, last).otherwise(branch), F.lit(" "), x["t"]))
    none = F.array().cast("array<string>")
    purpose = F.when(F.col("purpose").isNotNull(), F.array(F.concat(F.lit("  "), "purpose"))).otherwise(none)
    return joined.select("path", F.array_join(F.concat(F.array(head), purpose, F.coalesce(lines, none)), "\n").alias("text"))


def flat(files: DataFrame) -> DataFrame:
    """A line for each file, with its level."""
    return files.select("path", F.concat("path", F.coalesce(F.concat(F.lit(" ["), "level", F.lit("]")), F.lit(""))).alias("text"))


def issue_lines(issues: DataFrame) -> DataFrame:
    """A line for each issue: where, what, and when it expires."""
    when = F.coalesce(F.concat(F.lit(" expires "), F.col("expires").cast("string")), F.lit(""))
    return issues.select("path", "line_no", F.concat("path", F.lit(":"), F.col("line_no").cast("string"), F.lit(f" - {MARKER}"), "type", when).alias("text"))
