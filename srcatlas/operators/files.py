"""From annotation rows to file, symbol, call, import and issue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, unquote

OPENERS = ("symbol", "fn", "function", "class", "method")
HINTS = ("ai-careful", "ai-readonly", "ai-avoid", "ai-no-modify")
ISSUES = ("hack", "todo", "fixme", "critical", "perf")


def scoped(notes: DataFrame) -> DataFrame:
    """Annotations with their symbol: opener, its line and name; null outside symbols.

    An opener with a value opens a symbol, one without closes the open one.
    """
    opens = F.col("name").isin(*OPENERS)
    ordered = Window.partitionBy("path").orderBy("line_no")
    opener = F.last(F.when(opens, F.struct("line_no", "name", unquote(F.col("value")).alias("symbol"), "directive")), ignorenulls=True).over(ordered)
    return notes.withColumn("o", opener).select(
        *notes.columns,
        F.when(F.col("o.symbol").isNotNull(), F.col("o.line_no")).alias("symbol_line"),
        F.col("o.symbol").alias("symbol"),
        F.when(F.col("o.symbol").isNotNull(), F.col("o.name")).alias("opener"),
        F.when(F.col("o.symbol").isNotNull(), F.col("o.directive")).alias("opener_directive"),
    )


def _last(name: str, value: Column, keep: Column | None = None) -> Column:
    here = (F.col("name") == name) & value.isNotNull()
    return F.max_by(value, F.when(here if keep is None else here & keep, F.col("line_no"))).alias(name)


def listed(condition: Column, value: Column) -> Column:
    """The values of the matching rows, in line order."""
    held = F.array_sort(F.collect_list(F.when(condition & value.isNotNull(), F.struct("line_no", value.alias("v")))))
    return F.transform(held, lambda s: s["v"])


def split_list(value: Column) -> Column:
    return F.transform(F.split(value, ","), lambda v: unquote(F.trim(v)))


def fold_files(notes: DataFrame) -> DataFrame:
    """One row per path: last-wins scalars and lists in line order."""
    value = F.col("plain")
    outside = F.col("symbol").isNull()
    hint = F.when(F.col("value").isNull(), F.col("name")).otherwise(F.concat_ws(": ", "name", value))
    rows = scoped(notes).withColumn("plain", unquote(F.col("value")))
    made = rows.groupBy("path").agg(
        _last("module", value),
        _last("summary", value, outside),
        _last("layer", value),
        _last("lock", value),
        F.max_by("directive", F.when(F.col("name") == "lock", F.col("line_no"))).alias("lock_directive"),
        _last("purpose", F.coalesce(value, "directive")),
        _last("owner", value),
        _last("version", value),
        _last("since", value, outside),
        _last("license", value),
        _last("author", value),
        listed(F.col("name") == "domain", value).alias("domains"),
        listed(F.col("name").isin(*HINTS), hint).alias("ai_hints"),
        F.flatten(listed(F.col("name").isin("imports", "depends"), split_list(F.col("value")))).alias("imports"),
        listed(F.col("name").isin(*OPENERS), value).alias("exports"),
        F.count("*").alias("annotations"),
    )
    return made


def fold_symbols(notes: DataFrame) -> DataFrame:
    """One row per annotated symbol, with its behaviour, lifecycle, documentation and performance."""
    value = F.col("plain")
    flag = lambda *names: F.coalesce(F.bool_or(F.col("name").isin(*names)), F.lit(False))
    rows = scoped(notes).where(F.col("symbol").isNotNull()).withColumn("plain", unquote(F.col("value")))
    inner = F.col("line_no") > F.col("symbol_line")
    doc = lambda name: listed(inner & (F.col("name") == name), F.coalesce(value, "directive"))
    made = rows.groupBy("path", "symbol_line", "symbol", "opener").agg(
        F.max("opener_directive").alias("purpose"),
        _last("summary", value, inner),
        flag("pure").alias("pure"),
        flag("idempotent").alias("idempotent"),
        flag("async").alias("async"),
        flag("generator").alias("generator"),
        _last("memoized", F.coalesce(value, F.lit("true"))),
        _last("throttled", value),
        flag("transactional").alias("transactional"),
        F.flatten(listed(F.col("name") == "side-effects", split_list(F.col("value")))).alias("side_effects"),
        _last("deprecated", F.coalesce("directive", value)),
        flag("experimental").alias("experimental"),
        flag("beta").alias("beta"),
        flag("internal").alias("internal"),
        flag("public-api").alias("public_api"),
        _last("since", value, inner),
        doc("example").alias("examples"),
        doc("see").alias("see"),
        doc("link").alias("links"),
        doc("note").alias("notes"),
        doc("warning").alias("warnings"),
        listed(inner & (F.col("name") == "todo"), F.coalesce("directive", value, F.lit("Pending work item"))).alias("todos"),
        _last("perf", value),
        _last("memory", value),
        _last("cached", F.coalesce(value, F.lit("true"))),
        F.flatten(listed(F.col("name") == "calls", split_list(F.col("value")))).alias("calls"),
    )
    kind = F.when(F.col("opener") == "class", "class").when(F.col("opener") == "method", "method").otherwise("function")
    return made.select(
        "path",
        F.col("symbol").alias("name"),
        F.concat_ws(":", "path", "symbol").alias("qualified_name"),
        kind.alias("type"),
        F.col("symbol_line").alias("line_start"),
        (F.col("symbol_line") + 10).alias("line_end"),
        F.lit(True).alias("exported"),
        F.lit("public").alias("visibility"),
        F.when(F.col("opener") != "symbol", F.col("purpose")).alias("purpose"),
        *[c for c in made.columns if c not in ("path", "symbol_line", "symbol", "opener", "purpose")],
    )


def call_edges(notes: DataFrame) -> DataFrame:
    """caller, callee, path, line_no of every annotated call."""
    rows = scoped(notes).where((F.col("name") == "calls") & F.col("symbol").isNotNull() & F.col("value").isNotNull())
    return rows.select(F.col("symbol").alias("caller"), F.explode(split_list(F.col("value"))).alias("callee"), "path", "line_no")


def type_tags(notes: DataFrame) -> DataFrame:
    """Parameters, results and type parameters of annotated symbols.

    ``{T} name``, ``{T} [name]``, ``{T} [name=default]``; ``{T}``; ``N extends C``.
    """
    rows = scoped(notes).where(F.col("symbol").isNotNull() & F.col("name").isin("param", "returns", "return", "template"))
    value = F.trim("value")
    typed = blank_to_null(F.regexp_extract(value, r"^\{([^}]*)\}", 1))
    rest = F.trim(F.regexp_replace(value, r"^\{[^}]*\}", ""))
    bracket = F.regexp_extract(rest, r"^\[([^\]]*)\]", 1)
    optional = rest.rlike(r"^\[[^\]]*\]")
    name = (
        F.when(F.col("name") == "template", F.regexp_extract(value, r"^(.*?)(?: extends .*|\s.*)?$", 1))
        .when(F.col("name") != "param", F.lit(None))
        .when(optional, F.trim(F.regexp_extract(bracket, r"^([^=]*)", 1)))
        .otherwise(unquote(F.regexp_extract(rest, r"^(\S*)", 1)))
    )
    made = rows.select(
        "path", "symbol", "line_no",
        F.when(F.col("name") == "return", "returns").otherwise(F.col("name")).alias("tag"),
        F.trim(name).alias("name"),
        F.when(F.col("name") != "template", typed).alias("type"),
        F.when(F.col("name") == "param", optional).otherwise(F.lit(False)).alias("optional"),
        F.when((F.col("name") == "param") & optional & bracket.contains("="), F.trim(F.regexp_extract(bracket, r"=(.*)$", 1))).alias("default"),
        F.when(F.col("name") == "template", blank_to_null(F.regexp_extract(value, r" extends (.*)$", 1))).alias("constraint"),
        "directive",
    )
    return made.where("tag = 'returns' or (name is not null and name != '')")


def issues(notes: DataFrame) -> DataFrame:
    """Inline issues: hacks with expiry, ticket and reason, and the other kinds."""
    hack = F.col("name") == "hack"
    # tokens after a quoted one belong to the reason
    head = F.regexp_extract("value", r'^([^"]*)', 1)
    part = lambda key: F.when(hack, blank_to_null(F.regexp_extract(head, rf"(?:^|\s){key}=(\S+)", 1)))
    return notes.where(F.col("name").isin(*ISSUES)).select(
        "path", "line_no", F.col("name").alias("type"), "value", "directive", "auto_generated",
        part("expires").alias("expires"), part("ticket").alias("ticket"),
        F.when(hack, blank_to_null(F.regexp_extract("value", r'(?:^|\s)"([^"]*)', 1))).alias("reason"),
    )


def hacks(found: DataFrame) -> DataFrame:
    """Hacks with an id, a default reason and a date, or null for one that is none."""
    return found.where("type = 'hack'").select(
        F.concat_ws(":", "path", F.col("line_no").cast("string")).alias("id"), "path", "line_no",
        F.coalesce("reason", F.lit("Temporary workaround")).alias("reason"), "ticket", F.try_to_date("expires", "yyyy-MM-dd").alias("expires"),
    )


def apply_ast(annotated: DataFrame, parsed: DataFrame) -> DataFrame:
    """Parsed symbols replace a file's annotated ones and keep their summaries where they have none.

    Both: path, name, summary and further equal columns.
    """
    notes = annotated.groupBy("path", "name").agg(F.max_by("summary", "line_start").alias("noted"))
    joined = parsed.join(notes, ["path", "name"], "left").withColumn("summary", F.coalesce("summary", "noted")).drop("noted")
    rest = annotated.join(parsed.select("path").distinct(), "path", "left_anti")
    return joined.unionByName(rest, allowMissingColumns=True)


def ast_symbols(parsed: DataFrame) -> DataFrame:
    """Parsed symbol kinds and visibilities in stored terms; exported means public."""
    kind = (
        F.when(F.col("kind").isin("variable", "constant"), "const")
        .when(F.col("kind").isin("enum_variant"), "enum")
        .when(F.col("kind") == "impl", "class")
        .when(F.col("kind") == "type_alias", "type")
        .when(F.col("kind").isin("module", "namespace", "property", "field"), "function")
        .otherwise(F.col("kind"))
    )
    visible = F.when(F.col("visibility").isin("internal", "crate"), "private").otherwise(F.col("visibility"))
    return parsed.select(
        "path", "name", F.coalesce("qualified_name", F.concat_ws(":", "path", "name")).alias("qualified_name"), kind.alias("type"),
        "line_start", "line_end", (visible == "public").alias("exported"), visible.alias("visibility"), F.col("doc").alias("summary"), "signature", "async",
    )
