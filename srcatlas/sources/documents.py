"""Stored JSON documents to tables and back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructType, _parse_datatype_string

from ..schema import CACHE_NAMES

FILE = "struct<path:string,language:string,lines:bigint,module:string,summary:string,layer:string,exports:array<string>,imports:array<string>>"
SYMBOL = "struct<name:string,qualified_name:string,type:string,file:string,lines:array<bigint>,exported:boolean,summary:string>"
VARIABLE = "struct<type:string,value:string,description:string,refs:array<string>,source:string,lines:array<bigint>>"


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: file and its text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("json"))


def table_of(documents: DataFrame, field: str, entry: str) -> DataFrame:
    """A map field's entries as rows: key and the entry's fields; unknown fields are ignored."""
    value = _parse_datatype_string(entry)
    held = F.from_json("json", StructType().add(field, MapType(StringType(), value)))
    rows = documents.select(F.explode(held[field]).alias("key", "entry"))
    return rows.select("key", "entry.*")


def files(documents: DataFrame) -> DataFrame:
    return table_of(documents, "files", FILE)


def symbols(documents: DataFrame) -> DataFrame:
    return table_of(documents, "symbols", SYMBOL)


def variables(documents: DataFrame) -> DataFrame:
    return table_of(documents, "variables", VARIABLE)


def compact(row_columns: list[str], types: dict[str, str]) -> list:
    """Columns for export: empty arrays and false flags become null, which JSON leaves out."""
    out = []
    for c in row_columns:
        kind = types[c]
        if kind.startswith("array") or kind.startswith("map"):
            out.append(F.when(F.size(c) > 0, F.col(c)).alias(c))
        elif kind == "boolean":
            out.append(F.when(F.col(c), F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return out


def entries(rows: DataFrame, key: str) -> DataFrame:
    """key and entry JSON of every row, the form in which large tables are exported (one line each)."""
    kinds = dict(rows.dtypes)
    return rows.select(F.col(key).alias("key"), F.to_json(F.struct(*compact([c for c in rows.columns if c != key] + [key], kinds))).alias("entry"))


def document(rows: DataFrame, key: str, field: str) -> DataFrame:
    """One JSON object of a table of exportable size, keys sorted."""
    line = F.concat(F.to_json(F.array("key")), F.lit(""))
    name = F.regexp_replace(line, r"^\[|\]$", "")
    held = entries(rows, key).agg(F.array_sort(F.collect_list(F.concat(name, F.lit(":"), "entry"))).alias("e"))
    return held.select(F.concat(F.lit('{"' + field + '":{'), F.array_join("e", ","), F.lit("}}")).alias("json"))


def variables_path(cache_path: str) -> str:
    """Where variables of a stored document go."""
    if cache_path.endswith(CACHE_NAMES[0]):
        return cache_path[: -len(CACHE_NAMES[0])] + CACHE_NAMES[1]
    if cache_path.endswith("cache.json"):
        return cache_path[: -len("cache.json")] + "vars.json"
    return cache_path.rsplit(".", 1)[0] + ".vars.json"


ATTEMPT = "id string, status string, for_issue string, description string, created_at string, files array<struct<path:string,original_hash:string,modified_hash:string>>"


def attempts(documents: DataFrame) -> DataFrame:
    """The attempts of an attempts document, a row each."""
    held = documents.select(F.from_json("json", f"struct<attempts:map<string,struct<{_fields(ATTEMPT)}>>>").alias("d"))
    return held.select(F.explode("d.attempts").alias("key", "a")).select("key", "a.*")


def _fields(ddl: str) -> str:
    """A table's columns as a struct's."""
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", ddl)
