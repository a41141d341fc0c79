"""Names and texts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body) -> Column:
    """What ``body`` makes of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unquote(value: Column) -> Column:
    """Without the double quotes around it."""
    return F.regexp_replace(value, r'^"+|"+$', "")


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def tokens(value: Column) -> Column:
    """Estimated tokens: a quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(value) / 4).cast("long")


def truncated(value: Column, most: int) -> Column:
    """At most ``most`` characters, the last three of them dots if something was cut."""
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most - 3), F.lit("..."))).otherwise(value)


def words(name: Column) -> Column:
    """An identifier's words: split at underscores, hyphens and capitals."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"(?<!^)(?=[A-Z])", " "), r"[_-]", " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def capitalize(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))


def humanize(name: Column) -> Column:
    """Words with a capital first one and the rest in lower case."""
    return F.array_join(F.transform(words(name), lambda w, i: F.when(i == 0, capitalize(w)).otherwise(F.lower(w))), " ")


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """Per cent, ``empty`` of nothing."""
    return F.when(whole == 0, F.lit(empty)).otherwise(100.0 * part / whole)
