"""Rules for the six kinds of stored documents, held against their JSON as VARIANT values.

A rule names a place, a field there and what must hold; places end in the
entries of an object or of a list alike, so both forms of a table are checked.
Fields that no rule names may hold anything.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_name
from ..schema import ATTEMPT_STATES, LANGUAGES, LOCK_LEVELS, SYMBOL_TYPES, TOOLS, VARIABLE_TYPES
from .validation import kind_of

#: The entries of what stands before, in a place.
EACH = "*"


@dataclass(frozen=True)
class Rule:
    """``broken`` gets the field's value as VARIANT (null if there is none) and the place's, and may be null for no."""

    kind: str
    place: tuple[str, ...]
    field: str | None
    message: str
    broken: Callable[[Column, Column], Column]


def get(value: Column, field: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{field}", kind)


def _is(value: Column, *kinds: str) -> Column:
    """Whether a value is there and of a kind: STRING, BOOLEAN, OBJECT, ARRAY, or NUMBER."""
    names = "|".join({"NUMBER": "BIGINT|DECIMAL|DOUBLE|FLOAT"}.get(k, k) for k in kinds)
    return F.schema_of_variant(value).rlike(f"^({names})")


def text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def missing(value: Column, _: Column) -> Column:
    return value.isNull()


def no(*kinds: str) -> Callable:
    return lambda value, _: ~_is(value, *kinds)


def outside(allowed: tuple[str, ...]) -> Callable:
    return lambda value, _: ~_is(value, "STRING") | ~text(value).isin(*allowed)


def unlike(pattern: str) -> Callable:
    return lambda value, _: ~_is(value, "STRING") | ~text(value).rlike(pattern)


def below(least: float, most: float | None = None) -> Callable:
    def broken(value: Column, _: Column) -> Column:
        number = F.try_variant_get(value, "$", "double")
        return ~_is(value, "NUMBER") | (number < least) | (F.lit(False) if most is None else number > most)

    return broken


def empty(value: Column, _: Column) -> Column:
    held = F.coalesce(F.size(F.try_variant_get(value, "$", "map<string,variant>")), F.size(F.try_variant_get(value, "$", "array<variant>")))
    return value.isNotNull() & (F.coalesce(held, F.lit(0)) <= 0)


def backwards(first: str, last: str) -> Callable:
    return lambda _, entry: F.to_timestamp(get(entry, first, "string")) > F.to_timestamp(get(entry, last, "string"))


# Forms and enumerations of stored documents.
VERSION, MD5 = r"^\d+\.\d+\.\d+", r"^[0-9a-f]{32}$"
BEHAVIORS = ("conservative", "balanced", "aggressive")
STRICTNESS = ("permissive", "strict")


def _rules() -> list[Rule]:
    made = []
    add = lambda kind, place, field, message, broken: made.append(Rule(kind, place, field, message, broken))
    for kind in ("cache", "vars", "config", "attempts", "sync", "primer"):
        add(kind, (), "version", "version is missing", missing)
        add(kind, (), "version", "version is no version", unlike(VERSION))
    for field in ("generated_at", "project", "stats", "files", "symbols"):
        add("cache", (), field, f"{field} is missing", missing)
    add("cache", ("files", EACH), "language", "unknown language", outside(LANGUAGES))
    add("cache", ("files", EACH), "lines", "lines is no count", below(0))
    add("cache", ("symbols", EACH), "type", "unknown type", outside(SYMBOL_TYPES))
    add("cache", ("constraints", "files", EACH), "behavior", "unknown behavior", outside(BEHAVIORS))
    add("vars", (), "variables", "variables is missing", missing)
    add("vars", ("variables", EACH), "type", "unknown type", outside(VARIABLE_TYPES))
    add("vars", ("variables", EACH), "value", "value is missing", missing)
    add("config", ("constraints", "defaults"), "lock", "unknown lock level", outside(LOCK_LEVELS))
    add("config", ("defaults",), "lock", "unknown lock level", outside(LOCK_LEVELS))
    add("config", ("defaults",), "behavior", "unknown behavior", outside(BEHAVIORS))
    add("config", (), "strictness", "unknown strictness", outside(STRICTNESS))
    add("config", ("indexing",), "include", "include is no list", no("ARRAY"))
    add("config", ("indexing",), "exclude", "exclude is no list", no("ARRAY"))
    add("attempts", ("attempts", EACH), "status", "unknown status", outside(ATTEMPT_STATES))
    add("attempts", ("attempts", EACH, "files", EACH), "hash", "hash is no MD5", unlike(MD5))
    add("attempts", ("history", EACH), None, "ended before it started", backwards("started_at", "ended_at"))
    add("sync", ("tools", EACH), None, "unknown tool", outside(TOOLS))
    add("sync", ("exclude", EACH), None, "unknown tool", outside(TOOLS))
    add("sync", (), "enabled", "enabled is no flag", no("BOOLEAN"))
    add("sync", (), "debounceMs", "debounceMs is no count", below(0))
    add("primer", (), "sections", "sections is missing", missing)
    add("primer", (), "sections", "sections is empty", empty)
    for field in ("id", "category", "tokens", "value", "formats"):
        add("primer", ("sections", EACH), field, f"{field} is missing", missing)
    add("primer", ("sections", EACH), "formats", "formats is empty", empty)
    add("primer", ("sections", EACH), "conflictsWith", "conflicts with itself", lambda value, entry: F.array_contains(F.try_variant_get(value, "$", "array<string>"), get(entry, "id", "string")))
    return made


RULES = _rules()


def entries(documents: DataFrame, place: tuple[str, ...]) -> DataFrame:
    """name, spot and value (VARIANT) of every entry at a place of documents (name, value)."""
    spark = documents.sparkSession
    rows = documents.select("name", F.lit("").alias("spot"), "value")
    for step in place:
        if step == EACH:
            each = rows.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).toDF("pos", "key", "entry"))
            rows = each.select("name", F.concat_ws(".", "spot", F.coalesce("key", F.col("pos").cast("string"))).alias("spot"), F.col("entry").alias("value"))
        else:
            rows = rows.select("name", F.when(F.col("spot") == "", F.lit(step)).otherwise(F.concat_ws(".", "spot", F.lit(step))).alias("spot"), get(F.col("value"), step).alias("value"))
            rows = rows.where("value is not null")
    return rows


def check(documents: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """name, kind, spot and message of all that is wrong with documents (name, json).

    A document must be a JSON object of a known kind, told by its name, else by
    its schema link; what is missing breaks no rule but those that ask for it.
    """
    rules = RULES if rules is None else rules
    parsed = documents.select("name", F.try_parse_json("json").alias("value"))
    told = parsed.withColumn("kind", kind_of(file_name(F.col("name")), F.coalesce(F.try_variant_get("value", "$['$schema']", "string"), F.lit(""))))
    is_object = F.coalesce(_is(F.col("value"), "OBJECT"), F.lit(False))
    whole = F.when(~is_object, "is no JSON object").when(F.col("kind").isNull(), "is of no known kind")
    out = told.select("name", "kind", F.lit("").alias("spot"), whole.alias("message")).where("message is not null")
    objects = told.where(is_object)
    for kind, place in dict.fromkeys((r.kind, r.place) for r in rules):
        value = F.col("value")
        field = lambda r: value if r.field is None else get(value, r.field)  # noqa: B023,E731
        here = [r for r in rules if (r.kind, r.place) == (kind, place)]
        found = F.array_compact(F.array(*[F.when(F.coalesce(r.broken(field(r), value), F.lit(False)), F.lit(r.message)) for r in here]))
        rows = entries(objects.where(F.col("kind") == kind), place)
        out = out.unionByName(rows.select("name", F.lit(kind).alias("kind"), "spot", F.explode(found).alias("message")))
    return out


def table_of(documents: DataFrame, field: str) -> DataFrame:
    """name, key and entry (VARIANT, with all that it holds) of a table's entries; ``to_json`` gives them back."""
    rows = entries(documents.select("name", F.try_parse_json("json").alias("value")), (field, EACH))
    return rows.select("name", F.substring("spot", len(field) + 2, 1 << 30).alias("key"), F.col("value").alias("entry"))
