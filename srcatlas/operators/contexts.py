"""Answers for tasks: what to know before creating, changing or debugging a file, or exploring a project."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import parent
from .conventions import convention_for, folder_language


def create(files: DataFrame, conventions: DataFrame, shown: int = 5) -> DataFrame:
    """Per folder: its language, naming pattern (its own or its nearest parent's) and some of its files."""
    folders = files.select(parent(F.col("path")).alias("folder")).distinct()
    patterns = convention_for(folders.select(F.col("folder").alias("path")), conventions).select(F.col("path").alias("folder"), "pattern")
    # only a folder's first files leave their tasks
    order = Window.partitionBy("folder").orderBy("path")
    first = files.select(parent(F.col("path")).alias("folder"), "path").distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= shown)
    listed = first.groupBy("folder").agg(F.array_sort(F.collect_list("path")).alias("similar"))
    return folders.join(folder_language(files), "folder", "left").join(patterns, "folder", "left").join(listed, "folder")


def modify(files: DataFrame, imported_by: DataFrame, constraints: DataFrame) -> DataFrame:
    """Per file: importers, constraint, exported symbols and first domain."""
    rows = files.select("path", "exports", F.array_min("domains").alias("domain"))
    joined = rows.join(imported_by.select("path", F.col("imported_by").alias("importers")), "path", "left").join(constraints.select("path", "level", "directive"), "path", "left")
    none = F.array().cast("array<string>")
    return joined.select("path", F.coalesce("importers", none).alias("importers"), F.coalesce(F.size("importers"), F.lit(0)).cast("long").alias("importer_count"), "level", "directive", F.col("exports").alias("symbols"), "domain")


def debug(files: DataFrame, symbols: DataFrame, hotpaths: DataFrame) -> DataFrame:
    """Per file: its imports, its symbols with type and purpose, and which of them are called most."""
    told = symbols.groupBy("path").agg(F.array_sort(F.collect_set(F.struct("name", "type", "purpose"))).alias("symbols"))
    hot = symbols.select("path", F.col("name").alias("callee")).join(hotpaths, "callee").groupBy("path").agg(F.array_sort(F.collect_set("callee")).alias("hotpaths"))
    none = F.array().cast("array<string>")
    rows = files.select("path", F.col("imports").alias("related")).join(told, "path", "left").join(hot, "path", "left")
    return rows.withColumn("hotpaths", F.coalesce("hotpaths", none))


def debug_symbol(files: DataFrame, symbols: DataFrame, hotpaths: DataFrame, most: int = 3) -> DataFrame:
    """Per symbol: where it is, its type and purpose, its file's imports, and up to ``most`` of the most called names that contain its own."""
    # as many names as the report of hot paths has
    hot = hotpaths.agg(F.array_sort(F.collect_list(F.struct((-F.col("calls")).alias("rank"), F.col("callee").alias("n")))).alias("hot"))
    rows = symbols.select(F.col("name").alias("target"), "path", "type", "purpose").join(files.select("path", F.col("imports").alias("related")), "path", "left")
    held = F.transform(F.filter("hot", lambda h: h["n"].contains(F.col("target"))), lambda h: h["n"])
    return rows.join(F.broadcast(hot)).select("target", "path", "type", "purpose", "related", F.slice(held, 1, most).alias("hotpaths"))


def explore(files: DataFrame, symbols: DataFrame, key_files: DataFrame) -> DataFrame:
    """One row: counts, the most frequent language, domains with their files, and key files."""
    # one pass over the files: the rest is a row for each language
    spoken = files.groupBy("language").agg(F.count("*").alias("n"), F.sum("lines").alias("lines"))
    first = F.min_by("language", F.when(F.col("language").isNotNull(), F.struct(-F.col("n"), "language"))).alias("primary_language")
    counted = spoken.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.sum("lines").alias("lines"), first)
    told = symbols.agg(F.count("*").alias("symbols"))
    domains = files.select("path", F.explode(F.array_distinct("domains")).alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    listed = domains.agg(F.array_sort(F.collect_list(F.struct(F.col("d").alias("name"), F.col("n").alias("files")))).alias("domains"))
    keys = key_files.agg(F.collect_list("path").alias("key_files"))
    whole = counted.join(F.broadcast(told)).join(F.broadcast(listed)).join(F.broadcast(keys))
    return whole.select("files", "lines", "symbols", "primary_language", "domains", "key_files")


def symbol_report(symbols: DataFrame, callers: DataFrame, callees: DataFrame) -> DataFrame:
    """Symbols with who calls them and whom they call."""
    to = callers.select(F.col("callee").alias("name"), "callers")
    out = callees.select(F.col("caller").alias("name"), "callees")
    return symbols.join(to, "name", "left").join(out, "name", "left")


def file_report(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files with their symbols in line order."""
    held = symbols.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_start", "name", "type", "line_end"))).alias("symbols"))
    return files.join(held, "path", "left")
