"""What source files say about themselves, what they should say, and the changes that close the gap.

``analyze`` gives three tables: existing annotations, gaps and coverage.
``suggest`` proposes annotations for the gaps from doc comments, names, paths,
visibility and history, and ``changes`` makes them edits for ``rewrite``.

A file is analysed in its own row: its lines, symbols and annotations are
arrays there, so nothing is shuffled and no line of a file becomes a row.  A
gap's suggestions are made in the gap's row.  ``existing`` and ``gaps`` give the
same from tables of lines and symbols.  Equal targets in different files stay
apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import parsers
from ..functions import docs as doc_comments
from ..functions.text import share
from ..schema import SYMBOL_WITHIN
from ..storage import written
from . import annotations, bridge, suggestions

# Languages whose symbols are known.
LANGUAGES = ("typescript", "javascript", "python", "rust", "go", "java")
_DECORATED = r"^(@[A-Za-z_]|#!?\[)"


@dataclass
class Analysis:
    """existing: path, line_no, target, kind, value.

    gaps: path, target, line, insertion_line, symbol_kind (null for a file), visibility, exported, doc, doc_start, doc_end, missing.
    coverage: path, existing, missing, coverage (existing annotations as a share of them and the gaps).
    """

    existing: DataFrame
    gaps: DataFrame
    coverage: DataFrame


def _symbols(parsed: DataFrame) -> DataFrame:
    return parsers.symbols(parsed).withColumn("target", F.coalesce("qualified_name", "name"))


def existing(text_lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """Annotations with what they are about: the next symbol that starts at most 20 lines below, else the file."""
    noted = annotations.existing(text_lines, suggestions.LEVELS["full"])
    near = suggestions.attach(noted, symbols.select("path", F.col("target").alias("name"), "line_start"))
    return near.select("path", "line_no", F.coalesce("symbol", "path").alias("target"), "kind", "value")


def _above(text_lines: DataFrame, starts: DataFrame) -> DataFrame:
    """path, line and insertion_line: the first of the decorators and attributes that stand right above a line."""
    plain = ~F.trim("text").rlike(_DECORATED)  # within the window, so lines are shuffled once for this and for comments
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    last = text_lines.select("path", "line_no", (F.coalesce(F.max(F.when(plain, F.col("line_no"))).over(before), F.lit(0)) + 1).alias("insertion_line"))
    return starts.join(last.withColumnRenamed("line_no", "line").hint("merge"), ["path", "line"], "left").withColumn("insertion_line", F.coalesce("insertion_line", "line"))


def _missing(level: str, said: Column, of_file: bool) -> Column:
    kinds = suggestions.LEVELS[level]
    wanted = ["module", *[k for k in ("summary", "domain") if k in kinds]] if of_file else [k for k in kinds if k != "module"]
    return F.array_except(F.array(*map(F.lit, wanted)), F.coalesce(said, F.array().cast("array<string>")))


def gaps(files: DataFrame, text_lines: DataFrame, parsed: DataFrame, noted: DataFrame, level: str = "standard") -> DataFrame:
    """Files and symbols that lack annotations of the level, with the doc comment that stands above the symbol.

    A file has gaps only if its language is known and it could be parsed.
    Private symbols have none, nor have those seen inside a package or crate
    unless they are types.  A doc comment without the marks of a block is taken
    to end right above its symbol.
    """
    said = noted.groupBy("path", "target").agg(F.collect_set("kind").alias("said"))  # kinds of a fixed list
    symbols = _symbols(parsed).where(suggestions.eligible(F.col("visibility"), F.col("kind")))
    open_ = symbols.join(said.hint("merge"), ["path", "target"], "left").withColumn("missing", _missing(level, F.col("said"), False)).where(F.size("missing") > 0)
    starts = open_.select("path", "target", F.col("line_start").alias("line"), F.col("kind").alias("symbol_kind"), "visibility", "exported", F.nullif("doc", F.lit("")).alias("doc"), "missing")
    with_doc = starts.where("doc is not null").select("path", F.col("target").alias("name"), F.col("line").alias("line_start")).distinct()
    ranges = annotations.doc_ranges(text_lines, with_doc).select("path", F.col("name").alias("target"), F.col("line_start").alias("line"), "doc_start", "doc_end")
    placed = _above(text_lines, starts).join(ranges.hint("merge"), ["path", "target", "line"], "left")
    height = annotations.line_count(F.col("doc"))
    guessed = F.col("doc_start").isNull() & (height > 0) & (F.col("line") > height)
    columns = ["path", "target", "line", "insertion_line", "symbol_kind", "visibility", "exported", "doc", "doc_start", "doc_end", "missing"]
    of_symbols = placed.withColumns(
        {"doc_start": F.when(guessed, F.col("line") - height).otherwise(F.col("doc_start")), "doc_end": F.when(guessed, F.col("line") - 1).otherwise(F.col("doc_end"))}
    ).select(*columns)
    known = files.where(F.col("language").isin(*LANGUAGES)).select("path").join(parsers.errors(parsed).hint("merge"), "path", "left_anti")
    whole = known.join(said.where("path = target").select("path", "said").hint("merge"), "path", "left").withColumn("missing", _missing(level, F.col("said"), True)).where(F.size("missing") > 0)
    one = F.lit(1).cast("long")
    of_files = whole.select("path", F.col("path").alias("target"), one.alias("line"), one.alias("insertion_line"), F.lit(False).alias("exported"), "missing")
    return of_symbols.unionByName(of_files, allowMissingColumns=True)


def _table(rows: DataFrame, column: Column, name: str) -> DataFrame:
    """Rows with one more column that is made once, however often it is read."""
    # a generator's own expression would lose the names of its structs
    return rows.withColumn("made", column).select("*", F.explode(F.array("made")).alias(name)).drop("made")


def _noted(text_lines: Column, symbols: Column, path: Column) -> Column:
    """``existing`` of one file: structs of line_no, target, kind and value."""

    def about(note: Column) -> Column:
        below = F.filter(symbols, lambda s: (s["line"] > note["line_no"]) & (s["line"] <= note["line_no"] + SYMBOL_WITHIN))
        near = F.array_min(F.transform(below, lambda s: F.struct(s["line"].alias("line"), s["target"].alias("target"))))
        return F.struct(note["line_no"].alias("line_no"), F.coalesce(near["target"], path).alias("target"), note["kind"].alias("kind"), note["value"].alias("value"))

    return F.transform(annotations.stated(text_lines, suggestions.LEVELS["full"]), about)


def _insertion(text_lines: Column, line: Column) -> Column:
    """The first of the decorators and attributes that stand right above a line."""
    plain = lambda t: ~F.trim(t).rlike(_DECORATED)
    return F.when(line > F.size(text_lines), line).otherwise(F.coalesce(annotations.last_line(text_lines, line, plain), F.lit(0).cast("long")) + 1)


def _open(text_lines: Column, symbols: Column, noted: Column, file: Column, level: str) -> Column:
    """``gaps`` of one file: structs of its columns."""

    def said(target: Column) -> Column:
        return F.transform(F.filter(noted, lambda n: n["target"] == target), lambda n: n["kind"])

    def gap(s: Column) -> Column:
        documented, height = s["doc"].isNotNull(), annotations.line_count(s["doc"])
        guess = F.when((height > 0) & (s["line"] > height), F.struct((s["line"] - height).alias("doc_start"), (s["line"] - 1).alias("doc_end")))
        place = F.when(documented, F.coalesce(annotations.doc_range(text_lines, s["line"]), guess))
        made = {
            "target": s["target"], "line": s["line"], "insertion_line": _insertion(text_lines, s["line"]), "symbol_kind": s["kind"], "visibility": s["visibility"],
            "exported": s["exported"], "doc": s["doc"], "doc_place": place, "missing": _missing(level, said(s["target"]), False),
        }
        return F.struct(*[c.alias(n) for n, c in made.items()])

    one, none = F.lit(1).cast("long"), F.lit(None).cast("string")
    whole = {
        "target": file["path"], "line": one, "insertion_line": one, "symbol_kind": none, "visibility": none, "exported": F.lit(False), "doc": none,
        "doc_place": F.lit(None).cast("struct<doc_start:bigint,doc_end:bigint>"), "missing": _missing(level, said(file["path"]), True),
    }
    of_file = F.when(file["known"], F.array(F.struct(*[c.alias(n) for n, c in whole.items()]))).otherwise(F.array())
    asked = F.filter(symbols, lambda s: suggestions.eligible(s["visibility"], s["kind"]))
    return F.filter(F.concat(F.transform(asked, gap), of_file), lambda g: F.size(g["missing"]) > 0)


def facts(files: DataFrame, level: str = "standard") -> DataFrame:
    """path, language, notes and open (gaps) of every file of (path, language, content), from the file's own row: nothing is shuffled."""
    rows = parsers.nested(files, "symbol")
    symbol = lambda r: F.struct(
        F.coalesce(r["qualified_name"], r["name"]).alias("target"), r["line_start"].alias("line"), r["kind"].alias("kind"), r["visibility"].alias("visibility"),
        r["exported"].alias("exported"), F.nullif(r["doc"], F.lit("")).alias("doc"),
    )
    known = F.col("language").isin(*LANGUAGES) & ~F.exists("parsed", lambda r: r["what"] == "error")
    made = rows.select(
        "path", "language", F.struct("path", F.coalesce(known, F.lit(False)).alias("known")).alias("file"), annotations.split("content").alias("text_lines"),
        F.transform(F.filter("parsed", lambda r: r["what"] == "symbol"), symbol).alias("symbols"),
    )
    made = _table(made, F.col("text_lines"), "lines")
    made = _table(made, _noted(F.col("lines"), F.col("symbols"), F.col("path")), "notes")
    made = _table(made, _open(F.col("lines"), F.col("symbols"), F.col("notes"), F.col("file"), level), "open")
    # a symbol defined twice at one line is one gap to suggest for
    key = lambda g: F.concat_ws(":", g["line"], g["target"])
    made = _table(made, F.transform("open", key), "keys")
    unlike = F.size(F.array_distinct("keys")) == F.size("keys")
    again = F.when(unlike, F.col("open").isNull()).otherwise
    marked = F.transform("open", lambda g, i: g.withField("repeated", again(F.array_position("keys", key(g)) <= i)))
    return made.select("path", "language", "notes", marked.alias("open"))


def analyze(files: DataFrame, level: str = "standard") -> Analysis:
    """The analysis of (path, language, content)."""
    found = written(facts(files, level))  # parsed once; read for annotations, gaps and coverage
    noted = found.select("path", F.explode("notes").alias("n")).select("path", "n.*")
    each = found.select("path", "language", F.explode("open").alias("g"))
    columns = ["path", "target", "line", "insertion_line", "symbol_kind", "visibility", "exported", "doc", "doc_start", "doc_end", "missing", "language", "repeated"]
    open_ = each.select("path", "language", "g.*").select("*", "doc_place.*").select(*columns)
    return Analysis(noted, open_, suggestions.coverage(found.select("path", F.size("notes").cast("long").alias("existing"), F.size("open").cast("long").alias("missing"))))


def suggest(open_: DataFrame, languages: DataFrame, level: str = "standard", least: float = 0.0, history: DataFrame | None = None) -> DataFrame:
    """One suggestion for each missing kind of a gap for which there is one, with the gap's places.

    ``languages``: path, language, of gaps that do not have it.  What a doc
    comment says comes first, then the heuristics in their order; a gap's
    suggestions are made in its row.
    """
    # a symbol defined twice at one line is one gap
    open_ = open_.where("not repeated") if "repeated" in open_.columns else open_.dropDuplicates(["path", "target", "line"])
    if "language" not in open_.columns:
        open_ = open_.join(languages.select("path", "language").hint("merge"), "path", "left")
    if history is not None:
        open_ = open_.join(history.select("path", F.struct("*").alias("past")).hint("merge"), "path", "left")
    past = F.col("past") if history is not None else None
    said = doc_comments.column(F.col("doc"), doc_comments.style_of(F.col("language")))
    # comments alone go to the parser
    read = open_.where("doc is not null and language is not null").withColumn("said", said)
    rows = read.unionByName(open_.where("doc is null or language is null"), allowMissingColumns=True)
    found = F.concat(bridge.found(F.col("said")), suggestions.found(F.col("path"), F.col("target"), F.col("symbol_kind"), F.col("visibility"), F.col("exported"), past))
    wanted = F.filter("missing", lambda k: k.isin(*suggestions.LEVELS[level]))
    first = lambda k: F.get(F.filter(F.col("found"), lambda s: (s["kind"] == k) & (s["confidence"] >= least)), F.lit(0))
    chosen = _table(rows, found, "found").withColumn("chosen", F.filter(F.transform(wanted, first), lambda s: s.isNotNull())).withColumn("s", F.explode("chosen"))
    return chosen.select(
        "path", "target", "line", "s.kind", "s.value", "s.confidence", "s.source", "s.ord", "insertion_line", F.col("symbol_kind").isNull().alias("is_file"),
        F.col("doc").isNotNull().alias("documented"), "doc_start", "doc_end",
    )


def changes(suggested: DataFrame, level: str = "standard", provenance: bool = False, generation: str | None = None) -> DataFrame:
    """Edits for ``rewrite``: one for each target with its suggestions in the order of the level's kinds, into its doc comment if it has one.

    Of a target that has several gaps in a file (overloads), all suggestions
    go to the first.  A doc comment of unknown place is taken to be the line
    above.
    """
    rank = F.array_position(F.array(*map(F.lit, suggestions.LEVELS[level])), F.col("kind"))
    first = Window.partitionBy("path", "target")
    one = suggested.withColumn("top", F.min("line").over(first)).where("line = top")
    assumed = F.col("documented") & F.col("doc_start").isNull() & (F.col("insertion_line") > 1)
    above = F.when(assumed, F.col("insertion_line") - 1)
    if provenance:
        texts = suggestions.with_source_lines(F.col("kind"), F.col("value"), F.col("source"), F.col("confidence"), F.lit(generation).cast("string"))
    else:
        texts = F.array(suggestions.rendered(F.col("kind"), F.col("value")))
    held = F.sort_array(F.collect_list(F.struct(rank.alias("rank"), texts.alias("t"))))
    made = one.groupBy("path", "target", "is_file").agg(
        F.min("insertion_line").alias("line"), F.max(F.coalesce("doc_start", above)).alias("doc_start"), F.max(F.coalesce("doc_end", above)).alias("doc_end"), held.alias("h")
    )
    return made.select("path", "target", "line", "is_file", "doc_start", "doc_end", F.flatten(F.transform("h", lambda x: x["t"])).alias("texts"))


def total(coverage: DataFrame) -> DataFrame:
    """One row over all files."""
    summed = coverage.agg(F.coalesce(F.sum("existing"), F.lit(0)).alias("existing"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"))
    return summed.select("existing", "missing", share(F.col("existing"), F.col("existing") + F.col("missing"), 100.0).alias("coverage"))
