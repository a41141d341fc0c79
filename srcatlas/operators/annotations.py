"""Annotation lines: extraction, continuations, default directives, provenance."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, bound, unquote
from ..schema import DIRECTIVES, LOCK_DIRECTIVES, MARKER, ORIGINS, REVIEW_BELOW

_M = re.escape(MARKER).replace("\\@", "@")
# The grammar of annotation lines.
#: Name, value and directive; a value ends at a spaced hyphen.
PATTERN = rf"{_M}([\w-]+)(?:\s+(.+?))?(?:\s+-\s+(.+))?$"
#: The same with values that hold no hyphen at all.
STRICT_PATTERN = rf"{_M}([\w-]+)(?:\s+([^-\n]+?))?(?:\s+-\s+(.+))?$"
CONTINUATION = r"^(?://|#|/?\*)\s{2,}(.+)$"
SOURCE = rf"{_M}source\s+({'|'.join(ORIGINS)})(?:\s+-\s+(.+))?$"
CONFIDENCE = rf"{_M}source-confidence\s+(\d+\.?\d*)(?:\s+-\s+(.+))?$"
REVIEWED = rf"{_M}source-reviewed\s+(true|false)(?:\s+-\s+(.+))?$"
GENERATION = rf'{_M}source-id\s+"?([a-zA-Z0-9\-]+)"?(?:\s+-\s+(.+))?$'


def by_path(files: DataFrame) -> DataFrame:
    """path and content dealt out by path: one shuffle of whole texts serves every window and fold of their lines."""
    return files.select("path", "content").repartition("path")


def _split(content: str) -> Column:
    body = F.regexp_replace(content, r"\r?\n\z", "")
    return F.when(F.length(content) == 0, F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


def split(content: str) -> Column:
    """The lines of a text; a missing text has none."""
    return F.coalesce(_split(content), F.array().cast("array<string>"))


def lines(files: DataFrame) -> DataFrame:
    """path, line_no (from 1), text; a final line break opens no line."""
    return files.select("path", F.posexplode(_split("content")).alias("at", "text")).select("path", (F.col("at") + 1).cast("long").alias("line_no"), "text")


def line_count(content: Column) -> Column:
    """Lines of a text, without splitting it."""
    breaks = F.length(content) - F.length(F.translate(content, "\n", ""))
    return F.when(F.length(content) == 0, 0).when(content.endswith("\n"), breaks).otherwise(breaks + 1).cast("long")


def default_directive(name: Column, value: Column) -> Column:
    """The directive that an annotation has if it states none."""
    locks = F.create_map(*[F.lit(x) for pair in LOCK_DIRECTIVES.items() for x in pair])
    rest = F.create_map(*[F.lit(x) for pair in DIRECTIVES.items() for x in pair])
    return (
        F.when(name == "lock", F.try_element_at(locks, F.coalesce(value, F.lit("normal"))))
        .when(name == "ref", F.format_string("Consult %s before making changes", value))
        .when(name == "purpose", unquote(value))
        .otherwise(F.try_element_at(rest, name))
    )


def _opened(strict: bool) -> Column:
    """A line without the closing of a block comment, which strict reading leaves in place."""
    return F.col("text") if strict else F.when(F.col("text").contains("*/"), F.regexp_replace("text", r"\s*\*/\s*$", "")).otherwise(F.col("text"))


def raw_annotations(text_lines: DataFrame, strict: bool = False) -> DataFrame:
    """path, line_no, name, value, directive as written on the line itself."""
    pattern = STRICT_PATTERN if strict else PATTERN
    hits = text_lines.where(F.col("text").contains(MARKER)).withColumn("text", _opened(strict))
    part = lambda i: blank_to_null(F.regexp_extract("text", pattern, i))
    return hits.select("path", "line_no", part(1).alias("name"), part(2).alias("value"), part(3).alias("directive")).where(F.col("name").isNotNull())


def annotations(text_lines: DataFrame, strict: bool = False) -> DataFrame:
    """Annotations with continued and default directives.

    Only annotation and continuation lines reach the window.  Numbering lines
    by the continuations before them makes an annotation and the unbroken run
    of continuations after it one partition.
    """
    pattern = STRICT_PATTERN if strict else PATTERN
    # most lines are neither and go before any other pattern is tried
    wanted = text_lines.where(F.col("text").contains(MARKER) | (F.col("text").rlike("^[/#*]") & F.col("text").rlike(CONTINUATION)))
    marked = wanted.withColumn("text", _opened(strict)).select(
        "path", "line_no", "text", (F.col("text").contains(MARKER) & F.col("text").rlike(pattern)).alias("is_note"), F.col("text").rlike(CONTINUATION).alias("is_more")
    )
    marked = marked.where("is_note or is_more")
    ordered = Window.partitionBy("path").orderBy("line_no")
    run = F.col("line_no") - F.sum(F.col("is_more").cast("long")).over(ordered)
    marked = marked.withColumn("run", run).withColumn("more", F.when(F.col("is_more"), F.trim(F.regexp_extract("text", CONTINUATION, 1))))
    later = Window.partitionBy("path", "run").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    part = lambda i: blank_to_null(F.regexp_extract("text", pattern, i))
    found = marked.withColumn("added", F.collect_list("more").over(later)).where("is_note")
    found = found.select("path", "line_no", part(1).alias("name"), part(2).alias("value"), part(3).alias("own"), "added")
    stated = F.nullif(F.concat_ws(" ", "own", F.array_join("added", " ")), F.lit(""))
    stated = F.nullif(F.trim(stated), F.lit(""))
    return found.select(
        "path",
        "line_no",
        "name",
        "value",
        F.coalesce(stated, default_directive(F.col("name"), F.col("value"))).alias("directive"),
        stated.isNull().alias("auto_generated"),
    )


def with_provenance(text_lines: DataFrame, strict: bool = False) -> DataFrame:
    """Annotations (but those about sources) with what the lines after them say about their source.

    Lines that end the search (no comment, or another annotation) number the
    segments, so one aggregation by (path, segment) sees an annotation and its
    source lines together.
    """
    pattern = STRICT_PATTERN if strict else PATTERN
    about = F.col("text").contains(MARKER + "source")
    comment = F.trim("text").rlike(r"^(//|\*|#|/\*)")
    grab = lambda p: blank_to_null(F.regexp_extract("text", p, 1))
    marked = text_lines.select(
        "path",
        "line_no",
        (~comment | (F.col("text").contains(MARKER) & ~about)).alias("ends"),
        F.when(F.col("text").contains(MARKER) & ~about, grab(pattern)).alias("name"),
        F.when(F.col("text").contains(MARKER) & ~about, blank_to_null(F.regexp_extract("text", pattern, 2))).alias("value"),
        *[F.when(about, grab(p)).alias(n) for p, n in ((SOURCE, "source"), (CONFIDENCE, "confidence"), (REVIEWED, "reviewed"), (GENERATION, "generation_id"))],
    ).where("ends or source is not null or confidence is not null or reviewed is not null or generation_id is not null")
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum(F.col("ends").cast("long")).over(before), F.lit(0))
    # an annotation ends the segment before it and opens its own
    marked = marked.withColumn("segment", ended + F.when(F.col("name").isNotNull(), 1).otherwise(0))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    owner = F.min_by(F.struct("line_no", "name", "value"), F.when(F.col("name").isNotNull(), F.col("line_no"))).alias("owner")
    grouped = marked.groupBy("path", "segment").agg(owner, last("source"), last("confidence"), last("reviewed"), last("generation_id"))
    grouped = grouped.where("owner.name is not null")
    found = F.coalesce("source", "confidence", "reviewed", "generation_id").isNotNull()
    return grouped.select(
        "path",
        F.col("owner.line_no").alias("line_no"),
        F.col("owner.name").alias("name"),
        F.col("owner.value").alias("value"),
        found.alias("has_marker"),
        F.coalesce("source", F.lit("explicit")).alias("source"),
        F.when(F.col("confidence").isNotNull(), F.least(F.col("confidence").cast("double"), F.lit(1.0))).alias("confidence"),
        F.when(F.col("reviewed").isNotNull(), F.col("reviewed") == "true").alias("reviewed"),
        "generation_id",
    )


def provenance_map(found: DataFrame, threshold: float = REVIEW_BELOW) -> DataFrame:
    """One row per file and annotation name, the last one's; unmarked ones are explicit and reviewed."""
    newest = Window.partitionBy("path", "name").orderBy(F.desc("line_no"))
    kept = found.withColumn("rank", F.row_number().over(newest)).where("rank = 1")
    return kept.select(
        "path",
        F.concat(F.lit(MARKER), "name").alias("key"),
        "value",
        "source",
        "confidence",
        F.coalesce(F.col("confidence") < threshold, F.lit(False)).alias("needs_review"),
        F.when(F.col("has_marker"), F.coalesce("reviewed", F.lit(False))).otherwise(F.lit(True)).alias("reviewed"),
        "generation_id",
    )


def legacy(text_lines: DataFrame) -> DataFrame:
    """Annotations without a directive, and the line rewritten with the default one."""
    pattern = rf"{_M}([\w-]+)(?:\s+(.+))?"
    hits = text_lines.where(F.col("text").contains(MARKER) & ~F.col("text").contains(" - "))
    hits = hits.select("path", "line_no", "text", blank_to_null(F.regexp_extract("text", pattern, 1)).alias("name"), blank_to_null(F.regexp_extract("text", pattern, 2)).alias("value"))
    hits = hits.where(F.col("name").isNotNull()).withColumn("directive", default_directive(F.col("name"), F.col("value")))
    return hits.where(F.col("directive").isNotNull()).withColumn("rewritten", F.concat("text", F.lit(" - "), "directive"))


_EXISTING = rf"{_M}([a-z][a-z0-9-]*)(?:\s+(.+))?$"


def _stated(text: Column) -> tuple[Column, Column]:
    """Kind and value of a line's first annotation."""
    return F.regexp_extract(text, _EXISTING, 1), unquote(F.trim(F.regexp_extract(text, _EXISTING, 2)))


def existing(text_lines: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The first annotation of a line, if it is of a known kind; quotes around values go."""
    kind, value = _stated(F.col("text"))
    found = text_lines.where(F.col("text").contains(MARKER)).select("path", "line_no", kind.alias("kind"), value.alias("value"))
    return found.where(F.col("kind").isin(*kinds))


def stated(lines: Column, kinds: tuple[str, ...]) -> Column:
    """The same of an array of lines: structs of line_no, kind and value."""
    numbered = F.transform(lines, lambda t, i: F.struct((i + 1).cast("long").alias("line_no"), t.alias("text")))
    told = lambda x: F.struct(x["line_no"].alias("line_no"), *[c.alias(n) for c, n in zip(_stated(x["text"]), ("kind", "value"), strict=True)])
    return F.filter(F.transform(F.filter(numbered, lambda x: x["text"].contains(MARKER)), told), lambda x: x["kind"].isin(*kinds))


def _plain(text: Column) -> Column:
    """Whether a trimmed line may stand between a comment and its symbol."""
    return (text == "") | text.startswith("//") | text.startswith("@") | text.startswith("*") | text.startswith("/**")


#: Lines above a symbol that are looked through before all of them are.
NEAR = 64


def last_line(lines: Column, before: Column, test) -> Column:
    """The last line above ``before`` that passes a test, or null; those nearby first."""

    def within(low: Column) -> Column:
        part = F.slice(lines, low, F.greatest(before.cast("int") - low, F.lit(0)))
        return F.array_max(F.filter(F.transform(part, lambda t, i: F.when(test(t), (i + low).cast("long"))), lambda n: n.isNotNull()))

    return F.coalesce(within(F.greatest(before.cast("int") - NEAR, F.lit(1))), F.when(before > NEAR + 1, within(F.lit(1))))


def doc_range(lines: Column, start: Column) -> Column:
    """``doc_ranges`` of a symbol in an array of lines: doc_start and doc_end of the block comment right above it, or null."""
    opening, closing = (lambda t: F.trim(t).startswith("/**")), (lambda t: F.trim(t).endswith("*/"))
    code = lambda t: ~_plain(F.trim(t)) & ~closing(t)
    range_ = lambda begin, end: F.when((begin <= end) & (start <= F.size(lines)), F.struct(begin.alias("doc_start"), end.alias("doc_end")))
    opened = lambda end: bound(F.when(end.isNotNull(), last_line(lines, start, opening)), lambda begin: range_(begin, end))
    # the first line from below that is not plain closes the comment, or there is none
    ended = last_line(lines, start, lambda t: code(t) | closing(t))
    return bound(bound(ended, lambda at: F.when(closing(F.get(lines, at.cast("int") - 1)), at)), opened)


def doc_ranges(text_lines: DataFrame, starts: DataFrame) -> DataFrame:
    """Where the block comment right above a symbol begins and ends.

    ``starts``: path, name, line_start.  Only blank lines, decorators and
    comment lines may stand between the comment and the symbol.  Lines carry
    their last comment opening, closing and code line, so one window by path
    answers for all symbols.
    """
    text = F.trim("text")
    plain = _plain(text)
    closing = text.endswith("*/")
    up_to = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda test: F.max(F.when(test, F.col("line_no"))).over(up_to)
    marked = text_lines.select(
        "path", "line_no", last(text.startswith("/**")).alias("doc_start"), last(closing).alias("doc_end"), last(~plain & ~closing).alias("code")
    )
    rows = starts.join(marked.hint("merge"), (starts["path"] == marked["path"]) & (starts["line_start"] == marked["line_no"])).select(starts["path"], "name", "line_start", "doc_start", "doc_end", "code")
    held = (F.col("doc_start") <= F.col("doc_end")) & (F.coalesce("code", F.lit(0)) < F.col("doc_end"))
    return rows.where(held).select("path", "name", "line_start", "doc_start", "doc_end")


def _migrated_lines(files: DataFrame) -> DataFrame:
    """The files with legacy annotations, each with its lines as (text, rewritten or null)."""
    pattern = rf"{_M}([\w-]+)(?:\s+(.+))?"

    def both(text: Column) -> Column:
        part = lambda i: blank_to_null(F.regexp_extract(text, pattern, i))
        found = F.array(F.struct(part(1).alias("name"), part(2).alias("value")))
        told = F.get(F.transform(found, lambda f: F.when(f["name"].isNotNull(), default_directive(f["name"], f["value"]))), F.lit(0))
        new = F.when(text.contains(MARKER) & ~text.contains(" - "), F.concat(text, F.lit(" - "), told))
        return F.struct(text.alias("text"), new.alias("rewritten"))

    # a list of none or one, so that a file's lines are made once and not again for the test of them
    kept = F.filter(F.array(F.transform(_split("content"), both)), lambda l: F.exists(l, lambda x: x["rewritten"].isNotNull()))
    return files.where(F.col("content").contains(MARKER)).select("path", "content", F.explode_outer(kept).alias("l")).where(F.col("l").isNotNull())


def migrated(files: DataFrame) -> DataFrame:
    """path, the text before and after legacy annotations got their directives, for changed files; rows stay where they are."""
    after = F.array_join(F.transform("l", lambda x: F.coalesce(x["rewritten"], x["text"])), "\n")
    return _migrated_lines(files).select("path", F.col("content").alias("before"), after.alias("after"))


def migration_script(files: DataFrame) -> DataFrame:
    """path, place, sign and text of every line of files with legacy annotations: those that stay, go and are added."""
    part = lambda sign, text: F.struct(F.lit(sign).alias("sign"), text.alias("text"))
    text, new = F.col("x.text"), F.col("x.rewritten")
    touched = _migrated_lines(by_path(files)).select("path", F.posexplode("l").alias("at", "x")).withColumn("line_no", (F.col("at") + 1).cast("long"))
    rows = touched.select("path", "line_no", F.posexplode(F.when(new.isNull(), F.array(part(" ", text))).otherwise(F.array(part("-", text), part("+", new)))).alias("i", "r"))
    return rows.select("path", F.struct("line_no", "i").alias("place"), "r.sign", "r.text")
