"""Writes suggested annotations into source texts."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound
from ..schema import MARKER

PLAN = "path string, content string, language string, line long, doc_start long, doc_end long, is_file boolean, texts array<string>"
#: Opening, line prefix and closing of a new comment, by language; ``//!`` only heads a file.
_BLOCK = ("/**", " * ", " */")


def style(language: str, is_file: bool) -> tuple[str | None, str, str | None]:
    if language == "python":
        return None, "# ", None
    if language == "go":
        return None, "// ", None
    if language == "rust":
        return None, "//! " if is_file else "/// ", None
    return _BLOCK


def apply(content: str, language: str, changes: list[dict]) -> str:
    """The text with all changes, applied from the bottom up.

    A change has line (of its target), texts, is_file, and the range of an
    existing doc comment.  Annotations go after that comment's first line, but
    for languages whose line comments stand above; kinds already in it are
    left out.
    """
    lines = content.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    for change in sorted(changes, key=lambda c: -c["line"]):
        opening, prefix, closing = style(language, bool(change["is_file"]))
        at = int(change["line"])
        target = lines[at - 1] if 0 < at <= len(lines) else ""
        indent = target[: len(target) - len(target.lstrip())]
        start = change.get("doc_start")
        texts = list(change["texts"])
        if start and start == start and (opening or language == "rust"):
            start = int(start)
            end = int(change.get("doc_end") or start + 20)
            present = set(re.findall(re.escape(MARKER) + r"[^\s\"]+", "\n".join(lines[start - 1 : end])))
            texts = [t for t in texts if t.split(" ", 1)[0] not in present]
            lines[start:start] = [indent + prefix + t for t in texts]
        elif texts:
            block = [indent + prefix + t for t in texts]
            if opening:
                block = [indent + opening, *block, indent + closing]
            lines[max(at - 1, 0) : max(at - 1, 0)] = block
    return "\n".join(lines)


def diff(before: str, after: str, path: str, context: int = 3) -> str:
    """A unified diff."""
    made = difflib.unified_diff(before.splitlines(), after.splitlines(), f"a/{path}", f"b/{path}", lineterm="", n=context)
    return "\n".join(made)


def plan(suggestions: DataFrame, rendered: str = "text") -> DataFrame:
    """One change per file and target: path, target, line, is_file, doc range, texts in order."""
    held = F.array_sort(F.collect_list(F.struct("ord", F.col(rendered).alias("t"))))
    made = suggestions.groupBy("path", "target", "line", "is_file").agg(F.max("doc_start").alias("doc_start"), F.max("doc_end").alias("doc_end"), held.alias("h"))
    return made.select("path", "target", "line", "is_file", "doc_start", "doc_end", F.transform("h", lambda x: x["t"]).alias("texts"))


def _inserted(lines: Column, language: Column, change: Column) -> Column:
    """The lines that a change adds, each with its place: the line before which it goes, and what orders lines of one place."""
    block, rust = ~language.isin("python", "go", "rust"), language == "rust"
    prefix = F.when(language == "python", "# ").when(language == "go", "// ").when(rust & change["is_file"], "//! ").when(rust, "/// ").otherwise(" * ")
    indent = F.coalesce(F.regexp_extract(F.get(lines, change["line"].cast("int") - 1), r"^(\s*)", 1), F.lit(""))
    start = change["doc_start"].cast("int")
    last = F.coalesce(change["doc_end"].cast("int"), start + 20)
    said = F.regexp_extract_all(F.array_join(F.slice(lines, start, F.greatest(last - start + 1, F.lit(0))), "\n"), F.lit("(" + re.escape(MARKER) + r'[^\s"]+)'), 1)
    put = lambda xs, at: F.transform(xs, lambda x, i: F.struct(at.alias("line_no"), F.lit(0).alias("rank"), (~change["is_file"]).alias("later"), change["target"].alias("target"), i.alias("i"), F.lit("+").alias("sign"), x.alias("text")))
    line = lambda t: F.concat(indent, prefix, t)
    commented = F.concat(F.array(F.concat(indent, F.lit("/**"))), F.transform(change["texts"], line), F.array(F.concat(indent, F.lit(" */"))))
    above = F.least(F.greatest(change["line"].cast("int"), F.lit(1)), F.size(lines) + 1)
    new = F.when(block, commented).otherwise(F.transform(change["texts"], line))
    fresh = bound(said, lambda known: F.transform(F.filter(change["texts"], lambda t: ~F.array_contains(known, F.substring_index(t, " ", 1))), line))
    return F.when((start > 0) & (block | rust), put(fresh, F.least(start, F.size(lines)) + 1)).when(F.size(change["texts"]) > 0, put(new, above)).otherwise(put(F.array().cast("array<string>"), above))


def script(files: DataFrame, changes: DataFrame) -> DataFrame:
    """path, place, sign and text: every line of each changed file, those that stay (a blank) and those that are added (``+``).

    Where several changes add lines at one place, those of the file come first,
    then others by target.  Without a target line there is no indentation;
    changes below the text go to its end.
    """
    rows = _edited(files, changes).select("path", F.explode("edited").alias("r"))
    return rows.select("path", F.struct("r.line_no", "r.rank", "r.later", "r.target", "r.i").alias("place"), "r.sign", "r.text")


def _edited(files: DataFrame, changes: DataFrame) -> DataFrame:
    """path and the lines of each changed file as one array, each with its place."""
    held = changes.groupBy("path").agg(F.collect_list(F.struct("line", "is_file", "doc_start", "doc_end", "texts", "target")).alias("changes"))
    cut = F.split("content", "\n", -1)
    own = files.select("path", F.coalesce("language", F.lit("")).alias("language"), F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut).alias("lines"))
    none = F.lit("").alias("target")
    stay = F.transform("lines", lambda t, i: F.struct((i + 1).alias("line_no"), F.lit(1).alias("rank"), F.lit(False).alias("later"), none, F.lit(0).alias("i"), F.lit(" ").alias("sign"), t.alias("text")))
    added = F.flatten(F.transform("changes", lambda c: _inserted(F.col("lines"), F.col("language"), c)))
    return own.join(held.hint("merge"), "path").select("path", F.concat(stay, added).alias("edited"))


def rewritten(files: DataFrame, changes: DataFrame) -> DataFrame:
    """path and the text of each changed file with its changes, without a last line end; lines are put in order where the text lies."""
    return _edited(files, changes).select("path", F.array_join(F.transform(F.sort_array("edited"), lambda x: x["text"]), "\n").alias("content"))


def hunks(edited: DataFrame, context: int = 3) -> DataFrame:
    """path and unified diff of a script of lines that stay (a blank), go (``-``) or are added (``+``), in the order of ``place``.

    Changes with no line between them are one island, first what goes, then what
    is added; lines within ``context`` of a change are shown, and shown lines
    without a gap are one hunk.  Files without a change have no row.
    """
    stays, by = F.col("sign") == " ", Window.partitionBy("path")
    before = Window.unboundedPreceding
    islands = edited.withColumn("island", F.count_if(stays).over(by.orderBy("place").rowsBetween(before, -1)))
    kind = F.when(stays, 2).when(F.col("sign") == "-", 0).otherwise(1)
    ordered, back = by.orderBy("island", kind, "place"), by.orderBy(F.desc("island"), F.desc(kind), F.desc("place"))
    change = F.when(~stays, F.col("island"))
    placed = islands.withColumns(
        {
            "at": F.row_number().over(ordered),
            "old": F.count_if(F.col("sign") != "+").over(ordered.rowsBetween(before, -1)),
            "new": F.count_if(F.col("sign") != "-").over(ordered.rowsBetween(before, -1)),
            "since": F.col("island") + 1 - F.last(change, True).over(ordered.rowsBetween(before, 0)),
            "until": F.last(change, True).over(back.rowsBetween(before, 0)) - F.col("island"),
        }
    )
    shown = placed.where(~stays | (F.col("since") <= context) | (F.col("until") <= context))
    gap = F.coalesce(F.col("at") - F.lag("at").over(by.orderBy("at")) > 1, F.lit(True))
    numbered = shown.withColumn("gap", gap).withColumn("hunk", F.count_if(F.col("gap")).over(by.orderBy("at").rowsBetween(before, 0)))
    made = numbered.groupBy("path", "hunk").agg(
        F.min("old").alias("old"), F.min("new").alias("new"), F.count_if(F.col("sign") != "+").alias("olds"), F.count_if(F.col("sign") != "-").alias("news"),
        F.array_sort(F.collect_list(F.struct("at", F.concat("sign", "text").alias("t")))).alias("lines"),
    )
    span = lambda start, n: F.when(n == 1, (start + 1).cast("string")).when(n == 0, F.concat(start.cast("string"), F.lit(",0"))).otherwise(F.concat((start + 1).cast("string"), F.lit(","), n.cast("string")))
    head = F.concat(F.lit("@@ -"), span(F.col("old"), F.col("olds")), F.lit(" +"), span(F.col("new"), F.col("news")), F.lit(" @@"))
    text = made.select("path", "hunk", F.concat_ws("\n", head, F.transform("lines", lambda x: x["t"])).alias("text"))
    joined = text.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("hunk", "text"))).alias("hunks"))
    return joined.select("path", F.concat_ws("\n", F.concat(F.lit("--- a/"), "path"), F.concat(F.lit("+++ b/"), "path"), F.transform("hunks", lambda h: h["text"])).alias("diff"))


def contents(edited: DataFrame) -> DataFrame:
    """path and the text that a script leaves, without a last line end."""
    kept = edited.groupBy("path").agg(F.sort_array(F.collect_list(F.when(F.col("sign") != "-", F.struct("place", "text")))).alias("lines"))
    return kept.select("path", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("content"))


def preview(files: DataFrame, changes: DataFrame) -> DataFrame:
    """path, the new content and its diff (empty if nothing was added) of every changed file."""
    edited = script(files, changes)
    return contents(edited).join(hunks(edited), "path", "left").select("path", "content", F.coalesce("diff", F.lit("")).alias("diff"))


def between_markers(existing: str, section: str, begin: str, end: str) -> str:
    """``section`` in place of what stands between the markers, or appended with them."""
    block = f"{begin}\n{section}\n{end}"
    a, b = existing.find(begin), existing.find(end)
    if 0 <= a < b:
        before, after = existing[:a].rstrip(), existing[b + len(end) :].lstrip()
        return "".join((before, "\n\n" if before else "", "\n", block, "\n", "\n" if after else "", after))
    before = existing.rstrip()
    return f"{before}\n\n{block}" if before else block


def merged(existing: str, section: str, strategy: str, begin: str, end: str) -> str:
    """An existing text with a new one: ``replace``, ``append``, or ``section`` and ``merge`` between markers."""
    if strategy == "replace":
        return section
    if strategy == "append":
        return f"{existing.rstrip()}\n\n{section}"
    if strategy not in ("section", "merge"):
        raise ValueError(f"unknown strategy {strategy!r}")
    return between_markers(existing, section, begin, end)


def merged_json(existing: str, section: str) -> str:
    """An existing object with the keys of a new one put over its own; anything else stays as it is."""
    held, new = json.loads(existing), json.loads(section)
    if isinstance(held, dict) and isinstance(new, dict):
        held |= new
    return json.dumps(held, indent=2, sort_keys=True, ensure_ascii=False)


def merge_texts(rows: DataFrame, strategy: str, begin: str, end: str) -> DataFrame:
    """path and merged content from path, existing and section; a missing text is an empty one."""

    @F.pandas_udf("string")
    def run(existing: pd.Series, section: pd.Series) -> pd.Series:
        return pd.Series([merged(a or "", b or "", strategy, begin, end) for a, b in zip(existing, section, strict=True)])

    return rows.select("path", run("existing", "section").alias("content"))
