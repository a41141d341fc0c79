"""File naming conventions, dominant languages, and folders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import file_name, parent

# Suffixes of more than an extension, in the order in which they are tried.
SUFFIXES = (
    ".controller.ts", ".controller.js", ".service.ts", ".service.js", ".module.ts", ".module.js", ".route.ts", ".route.js",
    ".routes.ts", ".routes.js", ".spec.ts", ".spec.js", ".test.ts", ".test.js", ".types.ts", ".types.js", ".model.ts", ".model.js",
    ".dto.ts", ".dto.js", ".entity.ts", ".entity.js", ".component.tsx", ".component.ts", ".hook.ts", ".hook.tsx", ".util.ts",
    ".utils.ts", ".helper.ts", ".config.ts", ".config.js", ".const.ts", ".constants.ts", "_test.go", "_test.py", ".test.py", "_spec.rb",
)

# Suffixes that are taken for one another.
SIMILAR = (
    (".ts", ".tsx"), (".tsx", ".ts"), (".js", ".jsx"), (".jsx", ".js"), (".ts", ".js"), (".js", ".ts"),
    (".route.ts", ".routes.ts"), (".routes.ts", ".route.ts"), (".test.ts", ".spec.ts"), (".spec.ts", ".test.ts"),
    (".test.js", ".spec.js"), (".spec.js", ".test.js"), ("_test.go", "_test.ts"), (".service.ts", ".services.ts"),
    (".controller.ts", ".controllers.ts"),
)

# Files that make a pattern, the share that makes it dominant, examples shown.
LEAST_FILES, DOMINANT, EXAMPLES = 3, 0.7, 5


def suffix(name: Column) -> Column:
    """The compound suffix of a file name, else its extension, else nothing; none of the suffixes ends another."""
    compound = "|".join(re.escape(s) for s in SUFFIXES)
    return F.regexp_extract(name, rf"({compound}|\.[^.]*)$", 1)


def naming(files: DataFrame) -> DataFrame:
    """The dominant suffix of each folder, its share, examples, and similar suffixes that nobody uses there."""
    folder = F.when(parent(F.col("path")) == "", ".").otherwise(parent(F.col("path")))
    named = files.select(folder.alias("folder"), file_name(F.col("path")).alias("name"))
    seen = named.withColumn("suffix", F.when(~F.col("name").startswith("."), suffix(F.col("name"))))
    counted = seen.groupBy("folder", "suffix").agg(F.count("*").alias("n"))
    # only a folder's first names of each suffix leave their tasks
    order = Window.partitionBy("folder", "suffix").orderBy("name")
    first = seen.where(F.col("suffix").isNotNull()).distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= EXAMPLES)
    first = first.groupBy("folder", "suffix").agg(F.array_sort(F.collect_list("name")).alias("names"))
    counted = counted.join(first, ["folder", "suffix"], "left")
    whole = counted.groupBy("folder").agg(
        F.sum("n").alias("files"),
        F.sum(F.when(F.col("suffix").isNotNull(), F.col("n"))).alias("shown"),
        F.max(F.when(F.col("suffix").isNotNull(), F.struct("n", F.col("suffix").alias("s"), "names"))).alias("top"),
        F.collect_set("suffix").alias("used"),
    )
    rows = whole.where((F.col("files") >= LEAST_FILES) & (F.col("top.n") / F.col("shown") >= DOMINANT))
    similar = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SIMILAR])
    others = F.transform(F.filter(similar, lambda p: p["a"] == F.col("top.s")), lambda p: p["b"])
    return rows.select(
        "folder",
        F.concat(F.lit("*"), "top.s").alias("pattern"),
        (F.col("top.n") / F.col("shown")).alias("confidence"),
        F.slice("top.names", 1, EXAMPLES).alias("examples"),
        F.transform(F.array_except(others, "used"), lambda s: F.concat(F.lit("*"), s)).alias("avoid"),
    )


def import_style(files: DataFrame) -> DataFrame:
    """One row of import conventions if any file is TypeScript or JavaScript."""
    found = files.where(F.col("language").isin("typescript", "javascript")).limit(1)
    return found.select(F.lit("esm").alias("module_system"), F.lit("relative").alias("path_style"), F.lit(False).alias("index_exports"))


def folder_language(files: DataFrame) -> DataFrame:
    """The most frequent language of each folder; ties go by name."""
    counted = files.where(F.col("language").isNotNull()).groupBy(parent(F.col("path")).alias("folder"), "language").agg(F.count("*").alias("n"))
    return counted.groupBy("folder").agg(F.min_by("language", F.struct((-F.col("n")).alias("most"), "language")).alias("language"))


def convention_for(paths: DataFrame, conventions: DataFrame) -> DataFrame:
    """The convention of the longest folder that a path starts with.

    Every prefix of the path is an equi join key.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    spread = paths.select("path", F.explode(prefixes).alias("folder"))
    return spread.join(conventions.select("folder", "pattern"), "folder").groupBy("path").agg(F.max_by(F.struct("folder", "pattern"), F.length("folder")).alias("c")).select(
        "path", F.col("c.folder").alias("folder"), F.col("c.pattern").alias("pattern")
    )


def similar_files(files: DataFrame, most: int = 5) -> DataFrame:
    """Up to ``most`` other files in a file's folder, by name."""
    folder = parent(F.col("path"))
    # a file's own path may be among the first, so one more is kept
    order = Window.partitionBy("folder").orderBy("path")
    first = files.select(folder.alias("folder"), "path").distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= most + 1)
    listed = first.groupBy("folder").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    joined = files.select("path", folder.alias("folder")).join(listed, "folder")
    return joined.select("path", F.slice(F.array_remove("paths", F.col("path")), 1, most).alias("similar"))


def tree(files: DataFrame, depth: int = 3) -> DataFrame:
    """Folders down to ``depth`` with their own files and all files below, parents included."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, ".").otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    spread = files.select("path", "lines", F.posexplode(folders).alias("level", "folder"), (F.size(parts) - 1).alias("own"))
    rows = spread.groupBy("folder", "level").agg(
        F.count_if(F.col("level") == F.col("own")).alias("files"), F.count("*").alias("files_below"), F.sum("lines").alias("lines_below")
    )
    return rows.where(F.col("level") <= depth).select("folder", F.col("level").cast("long").alias("level"), "files", "files_below", "lines_below")
