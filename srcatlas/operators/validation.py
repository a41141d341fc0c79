"""Rules over stored documents: violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ATTEMPT_STATES, LANGUAGES, LOCK_LEVELS, SYMBOL_TYPES, TOOLS, VARIABLE_TYPES
from .graph import cycle_paths, cycles

# Parts of file names that tell a document's kind, first match first.
KINDS = ("cache", "vars", "config", "attempts", "sync", "primer")


def kind_of(name: Column, schema: Column) -> Column:
    """The kind of a document by its file name, else by its schema link."""
    made = F.when(F.lit(False), F.lit(None).cast("string"))
    for column in (F.lower(name), F.lower(schema)):
        for kind in KINDS:
            made = made.when(column.contains(kind), kind)
    return made


def _member(column: str, allowed: tuple[str, ...]) -> Column:
    return F.col(column).isNotNull() & ~F.col(column).isin(*allowed)


def rules(kind: str) -> list[tuple[str, Column]]:
    """(message, condition that breaks it) for the rows of a kind."""
    return {
        "files": [("path is missing", F.col("path").isNull()), ("unknown language", _member("language", LANGUAGES)), ("negative lines", F.col("lines") < 0)],
        "symbols": [("name is missing", F.col("name").isNull()), ("unknown type", _member("type", SYMBOL_TYPES)), ("lines run backwards", F.col("line_start") > F.col("line_end"))],
        "constraints": [("unknown lock level", _member("level", LOCK_LEVELS))],
        "vars": [("unknown type", _member("type", VARIABLE_TYPES)), ("value is missing", F.col("value").isNull())],
        "attempts": [("unknown status", _member("status", ATTEMPT_STATES)), ("ended before it started", F.col("ended_at") < F.col("started_at")), ("bad hash", ~F.col("hash").rlike("^[0-9a-f]{32}$"))],
        "sync": [("unknown tool", _member("tool", TOOLS)), ("tool is listed and excluded", F.col("listed") & F.col("excluded"))],
        "sections": [("conflicts with itself", F.array_contains("conflicts", F.col("id"))), ("no formats", F.col("formats") <= 0)],
    }[kind]


def violations(rows: DataFrame, kind: str, key: str) -> DataFrame:
    """key and message of every broken rule."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(message)) for message, test in rules(kind)]))
    return rows.select(F.col(key).alias("key"), F.explode(broken).alias("message"))


def unknown_dependencies(sections: DataFrame) -> DataFrame:
    """Dependencies on sections that do not exist."""
    asked = sections.select("id", F.explode("depends").alias("dependency"))
    return asked.join(sections.select(F.col("id").alias("dependency")), "dependency", "left_anti").select("id", "dependency")


def dependency_cycles(sections: DataFrame, most: int | None = None) -> DataFrame:
    """Sections that depend on themselves through others."""
    return cycles(sections.select(F.col("id").alias("src"), F.explode("depends").alias("dst")), most)


def circular_dependencies(sections: DataFrame) -> DataFrame:
    """section, cycle: one cycle, written ``a -> b -> a``, for each group of sections that depend on one another."""
    found = cycle_paths(sections.select(F.col("id").alias("src"), F.explode("depends").alias("dst")))
    return found.select(F.col("component").alias("section"), F.array_join("path", " -> ").alias("cycle"))


def tool_overlap(configs: DataFrame) -> DataFrame:
    """Warnings for sync settings that name a tool both to use and to leave out (key, tools, exclude)."""
    both = F.array_sort(F.array_intersect("tools", "exclude"))
    return configs.where(F.size(both) > 0).select("key", F.concat(F.lit("in tools and exclude: "), F.array_join(both, ", ")).alias("message"))


#: What each kind of document holds that has rules: the field, the rules' name, and the columns they need beside the entry's own.
_HELD = {
    "cache": ("files", "files", "struct<path:string,language:string,lines:bigint>"),
    "vars": ("variables", "vars", "struct<type:string,value:string>"),
    "attempts": ("attempts", "attempts", "struct<status:string,started_at:string,ended_at:string,hash:string>"),
}


def validate(documents: DataFrame) -> DataFrame:
    """Everything wrong with stored documents (name, json): name, kind, key and message.

    A document must be a JSON object of a known kind; the entries of caches,
    variables and attempts are held against their rules.
    """
    linked = F.get_json_object("json", "$['$schema']")
    told = documents.select("name", "json", kind_of(F.col("name"), F.coalesce(linked, F.lit(""))).alias("kind"), F.from_json("json", "map<string,string>", {"mode": "PERMISSIVE"}).alias("parsed"))
    whole = F.when(F.col("parsed").isNull(), "is no JSON object").when(F.col("kind").isNull(), "is of no known kind")
    out = told.select("name", "kind", F.lit(None).cast("string").alias("key"), whole.alias("message")).where(F.col("message").isNotNull())
    for kind, (field, named, entry) in _HELD.items():
        held = F.from_json("json", f"struct<{field}:map<string,{entry}>>")[field]
        rows = told.where((F.col("kind") == kind) & F.col("parsed").isNotNull()).select("name", F.explode(held).alias("k", "e"))
        broken = violations(rows.select(F.struct("name", "k").alias("at"), "e.*"), named, "at")
        out = out.unionByName(broken.select(F.col("key.name").alias("name"), F.lit(kind).alias("kind"), F.col("key.k").alias("key"), "message"))
    return out
