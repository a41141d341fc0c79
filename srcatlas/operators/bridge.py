"""Reconciles native documentation with annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import docs
from ..operators import annotations as notes
from ..schema import PRECEDENCES

# What tells documentation formats apart.
NUMPY = r"(?m)^\s*(Parameters|Returns|Raises|Yields|Examples?|Notes?|Attributes?)\s*\n\s*-{3,}"
SPHINX = r":(param|returns?|raises?|type|rtype)\s+"
GOOGLE = r"(?m)^\s*(Args|Arguments|Parameters|Returns|Raises|Yields|Examples?|Attributes?):\s*$"
JSDOC = r"@(param|returns?|throws?|deprecated|example|see)\b"
FORMATS = ("jsdoc", "docstring:google", "docstring:numpy", "docstring:sphinx", "rustdoc", "javadoc", "godoc")


def detect(content: Column, language: Column, style: str = "auto", disabled: tuple[str, ...] = ()) -> Column:
    """The documentation format of a file, or null; ``style`` forces a docstring style."""
    python = F.lit(f"docstring:{style}") if style != "auto" else (
        F.when(content.rlike(NUMPY), "docstring:numpy").when(content.rlike(SPHINX), "docstring:sphinx").when(content.rlike(GOOGLE), "docstring:google")
    )
    rust = (content.contains("///") | content.contains("//!")) | content.rlike(r"(?m)^#\s*(Arguments?|Returns?|Panics?|Errors?|Examples?|Safety)\s*$")
    found = (
        F.when(language.isin("javascript", "typescript"), F.when(content.rlike(JSDOC), "jsdoc"))
        .when(language == "python", python)
        .when(language == "rust", F.when(rust, "rustdoc"))
        .when(language.isin("java", "kotlin"), "javadoc")
        .when(language == "go", "godoc")
    )
    return F.when(~language.isin(*disabled), found) if disabled else found


def documented(content: Column, language: Column) -> Column:
    """Whether a file has documentation comments."""
    return (
        F.when(language.isin("javascript", "typescript"), content.rlike(r"/\*\*|@param|@returns"))
        .when(language == "python", content.contains('"""') | content.contains("'''"))
        .when(language == "rust", content.contains("///") | content.contains("//!"))
        .when(language.isin("java", "kotlin"), content.contains("/**"))
        .when(language == "go", content.rlike(r"(?m)^\s*//(?! \+build)"))
        .otherwise(False)
    )


def merge_summaries(pairs: DataFrame, precedence: str = PRECEDENCES[0]) -> DataFrame:
    """key, summary, directive, source from (key, native, noted, directive).

    Only one side: converted or explicit.  Both: the native summary leads
    unless it is missing; ``merge`` joins two different ones.
    """
    native, noted = F.col("native"), F.col("noted")
    has_notes = noted.isNotNull() | F.col("directive").isNotNull()
    both = {
        PRECEDENCES[0]: F.coalesce(native, noted),
        PRECEDENCES[1]: native,
        PRECEDENCES[2]: F.when(native.isNotNull() & noted.isNotNull() & (native != noted), F.concat_ws(" ", native, noted)).otherwise(F.coalesce(native, noted)),
    }[precedence]
    return pairs.select(
        "key",
        F.when(native.isNull(), noted).when(~has_notes, native).otherwise(both).alias("summary"),
        F.when(has_notes, F.col("directive")).alias("directive"),
        F.when(native.isNull(), "explicit").when(~has_notes, "converted").otherwise("merged").alias("source"),
    )


def merge_entries(native: DataFrame, noted: DataFrame, precedence: str = PRECEDENCES[0]) -> DataFrame:
    """Parameters (or exceptions) of both sides by (key, name): native order first, then the others.

    ``native``: key, ord, name, type, text; ``noted``: key, ord, name,
    directive.  Of repeated names the first counts.  Native precedence drops
    what only annotations name.
    """
    first = noted.groupBy("key", "name").agg(F.min_by(F.struct("ord", "directive"), "ord").alias("n"))
    joined = native.withColumn("have", F.lit(True)).join(first, ["key", "name"], "left" if precedence == PRECEDENCES[1] else "full")
    made = joined.select(
        "key",
        "name",
        "type",
        "text",
        F.col("n.directive").alias("directive"),
        F.when(F.col("have").isNull(), "explicit").when(F.col("n").isNotNull(), "merged").otherwise("converted").alias("source"),
        F.struct(F.col("have").isNull().alias("later"), F.coalesce("ord", "n.ord").alias("at")).alias("place"),
    )
    return made


def in_order(entries: DataFrame) -> DataFrame:
    """Each key's entries as one array."""
    held = entries.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "name", "type", "text", "directive", "source"))).alias("e"))
    return held.select("key", F.transform("e", lambda e: F.struct(e["name"], e["type"], e["text"], e["directive"], e["source"])).alias("entries"))


def found(doc: Column) -> Column:
    """Suggested annotations of a doc comment, as structs of kind, value, confidence, source and ord; none of a missing one."""
    d = lambda f: doc[f]
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    tag = lambda *names: F.get(F.filter(d("tags"), lambda t: t["name"].isin(*names)), F.lit(0))
    short = F.trim(d("summary"))
    cut = F.when(F.length(short) > 100, F.concat(F.regexp_replace(F.substring(short, 1, 100), r"\s\S*$", ""), F.lit("..."))).otherwise(short)
    lock = F.when(tag("private", "internal").isNotNull(), "restricted").when(tag("protected", "public").isNotNull(), "normal")
    every = F.concat(
        F.array(one("summary", cut), one("deprecated", d("deprecated"))),
        F.transform(d("see"), lambda x: one("ref", x)),
        F.transform(d("todos"), lambda x: one("hack", F.concat(F.lit('reason="'), x, F.lit('"')))),
        F.array(one("lock", lock), one("module", F.nullif(tag("module")["value"], F.lit(""))), one("domain", F.lower(F.nullif(tag("category")["value"], F.lit(""))))),
        F.array(
            one("ai-hint", F.when(F.size(d("throws")) > 0, F.concat(F.lit("throws "), F.array_join(F.transform(d("throws"), lambda t: t["type"]), ", ")))),
            one("ai-hint", F.when(tag("readonly").isNotNull(), F.lit("readonly"))),
            one("ai-hint", F.when(F.size(d("examples")) > 0, F.lit("has examples"))),
        ),
        F.transform(d("notes"), lambda x: one("ai-hint", x)),
    )
    told = lambda s, i: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), F.lit(1.0).alias("confidence"), F.lit("converted").alias("source"), i.cast("long").alias("ord"))
    return F.when(doc.isNotNull(), F.transform(F.filter(every, lambda s: s["value"].isNotNull()), told)).otherwise(F.array())


def suggestions(parsed: DataFrame) -> DataFrame:
    """Suggested annotations from (target, line, doc): the converted kind."""
    return parsed.select("target", "line", F.explode(found(F.col("doc"))).alias("s")).select("target", "line", "s.*")


def noted_in_docs(docs: DataFrame) -> DataFrame:
    """Summary, directive, params, returns and throws that annotations inside doc comments state.

    ``docs``: target, text.  A summary annotation beats a quoted text of a
    function's annotation; of equal ones the last counts, of functions' texts
    the first.
    """
    lines = notes.lines(docs.select(F.col("target").alias("path"), F.col("text").alias("content")))
    found = notes.annotations(lines)
    value, own = F.col("value"), F.trim(F.regexp_replace("value", r"^\{[^}]*\}", ""))
    called = F.col("name").isin("fn", "method")
    quoted = F.nullif(F.regexp_extract(value, r'^"([^"]*)"[\s-]*[^\s-]', 1), F.lit(""))
    # optional ones stand in brackets, with their default
    param = F.when(own.startswith("["), F.trim(F.regexp_extract(own, r"^\[([^=\]]*)[^\]]*\]", 1))).otherwise(F.regexp_extract(own, r"^(\S+)", 1))
    thrown = F.when(value.startswith("{"), F.regexp_extract(value, r"^\{([^}]*)\}", 1)).otherwise(F.regexp_extract(value, r"^(\S+)", 1))
    stated = F.coalesce("directive", F.lit(""))
    returned = F.coalesce("directive", F.nullif(F.trim(F.regexp_replace(own, "^-+", "")), F.lit("")))
    last = lambda test, v: F.max_by(v, F.when(test & v.isNotNull(), F.col("line_no")))
    pairs = lambda test, a: F.transform(F.array_sort(F.collect_list(F.when(test & (a != ""), F.struct("line_no", a.alias("name"), stated.alias("directive"))))), lambda x: F.struct(x["name"].alias("name"), x["directive"].alias("directive")))
    made = found.groupBy("path").agg(
        last(F.col("name") == "summary", value).alias("summary"),
        F.min_by(quoted, F.when(called & quoted.isNotNull(), F.col("line_no"))).alias("called"),
        last(called, F.col("directive")).alias("directive"),
        pairs(F.col("name") == "param", param).alias("params"),
        last(F.col("name") == "returns", returned).alias("returns"),
        pairs(F.col("name") == "throws", thrown).alias("throws"),
    )
    return made.select(F.col("path").alias("target"), F.coalesce("summary", "called").alias("summary"), "directive", "params", "returns", "throws")


def applied(symbols: DataFrame, precedence: str = PRECEDENCES[0]) -> DataFrame:
    """Symbols with the ``summary``, ``directive`` and ``bridge`` (merged, converted, explicit) that their doc comments give.

    ``symbols``: target (unique), language, format and doc, and further columns.
    A comment's own annotations are one side, its native documentation the
    other.  Symbols without a comment, or in files of no known format, have none.
    """
    if precedence not in PRECEDENCES:
        raise ValueError(f"unknown precedence {precedence!r}")
    told = symbols.select("target", "language", "doc").where(F.col("format").isNotNull() & F.col("doc").isNotNull())
    parsed = told.withColumn("d", docs.column(F.col("doc"), docs.style_of(F.col("language"))))
    native = parsed.select("target", F.col("d.summary").alias("native"), (F.col("d.summary").isNotNull() | (F.size("d.params") > 0) | F.col("d.returns").isNotNull() | (F.size("d.throws") > 0)).alias("is_native"))
    said = noted_in_docs(told.select("target", F.col("doc").alias("text")))
    noted = said.select(
        "target", F.regexp_replace("summary", '^"|"$', "").alias("noted"), "directive",
        (F.col("summary").isNotNull() | F.col("directive").isNotNull() | (F.size("params") > 0) | F.col("returns").isNotNull() | (F.size("throws") > 0)).alias("is_noted"),
    )
    pairs = native.join(noted, "target", "left")
    made = merge_summaries(pairs.withColumnRenamed("target", "key"), precedence).select(F.col("key").alias("target"), "summary", "directive")
    sides = pairs.select("target", F.when(F.col("is_native") & F.coalesce("is_noted", F.lit(False)), "merged").when(F.col("is_noted"), "explicit").when(F.col("is_native"), "converted").alias("bridge"))
    kept = symbols.drop("summary", "directive", "bridge")
    return kept.join(made.join(sides, "target"), "target", "left")


def counts(symbols: DataFrame, provenance: DataFrame) -> DataFrame:
    """path, explicit_count and converted_count of a file's annotations, merged_count of its symbols' comments."""
    n = lambda test, name: F.count_if(test).alias(name)
    rows = provenance.select("path", F.col("source").alias("s"), F.lit(None).cast("string").alias("b")).unionByName(symbols.select("path", F.lit(None).cast("string").alias("s"), F.col("bridge").alias("b")))
    return rows.groupBy("path").agg(n(F.col("s") == "explicit", "explicit_count"), n(F.col("s") == "converted", "converted_count"), n(F.col("b") == "merged", "merged_count"))


def status(symbols: DataFrame) -> DataFrame:
    """One row: documented symbols by what documents them (``native``, ``noted``: booleans)."""
    n = lambda test: F.count_if(test).alias
    native, noted = F.col("native"), F.col("noted")
    return symbols.agg(F.count("*").alias("symbols"), n(native & noted)("merged"), n(native & ~noted)("native_only"), n(~native & noted)("noted_only"), n(~native & ~noted)("bare"))
