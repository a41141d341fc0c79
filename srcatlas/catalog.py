"""From a source tree to tables, and tables to and from disk."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import parsers
from .config import Config
from .functions import docs as doc_comments
from .functions.paths import glob_regex
from .operators import annotations, bridge, conventions, files, graph, history, stats
from .sources import files as source_files
from .sources import git, tree
from .storage import written


@dataclass
class Catalog:
    """The tables of one project."""

    files: DataFrame
    symbols: DataFrame
    annotations: DataFrame
    provenance: DataFrame
    calls: DataFrame
    imports: DataFrame
    constraints: DataFrame
    hacks: DataFrame
    conventions: DataFrame
    #: path and problem of files that have no symbols, or are in no other table.
    problems: DataFrame

    def save(self, path: str) -> None:
        """Writes every table as Parquet below ``path``."""
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{f.name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        return cls(**{f.name: spark.read.parquet(f"{path.rstrip('/')}/{f.name}") for f in fields(cls)})

    def register(self, prefix: str = "") -> None:
        """Temporary views for SQL."""
        for f in fields(self):
            getattr(self, f.name).createOrReplaceTempView(f"{prefix}{f.name}")


def domains_by_pattern(config: Config, path: Column) -> Column:
    """Domains that the configuration's globs give a path."""
    none = F.array().cast("array<string>")
    if not config.domains:
        return none
    return F.array_compact(F.array(*[F.when(path.rlike("|".join(glob_regex(g) for g in globs) or "(?!)"), F.lit(name)) for name, globs in config.domains.items()]))


def build(sources: DataFrame, config: Config | None = None, commits: DataFrame | None = None) -> Catalog:
    """All tables of (path, language, content, modified_at): the indexing job.

    Extraction is narrow; folds shuffle once by path.  Parsed symbols replace
    annotated ones and take their summaries where they have none; with the
    bridge on, documentation and annotations are reconciled.
    """
    config = config or Config()
    lines = annotations.lines(sources)
    notes = annotations.annotations(lines)
    sourced = annotations.with_provenance(lines)
    provenance = annotations.provenance_map(sourced, config.review_below).withColumn("target", F.col("path"))

    parsed = parsers.parse(sources)
    ast = files.ast_symbols(parsers.symbols(parsed))
    if config.bridge:
        ast = written(_bridged(ast, sources, notes, config))  # read for symbols and for counts
    symbols = files.apply_ast(files.fold_symbols(notes), ast)

    folded = files.fold_files(notes)
    base = sources.select(
        "path", "language", annotations.line_count(F.col("content")).alias("lines"), bridge.detect(F.col("content"), F.col("language"), config.docstring_style).alias("detected_format")
    )
    joined = base.join(folded, "path", "left")
    empty = F.array().cast("array<string>")
    domains = F.array_distinct(F.concat(F.coalesce("domains", empty), domains_by_pattern(config, F.col("path"))))
    names = symbols.where("exported").groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("names"))
    specs = parsers.imports(parsed).groupBy("path").agg(F.array_sort(F.collect_set("source")).alias("specs"))
    table = joined.join(names, "path", "left").join(specs, "path", "left")
    table = table.withColumns(
        {
            "domains": domains,
            "exports": F.array_distinct(F.concat(F.coalesce("exports", empty), F.coalesce("names", empty))),
            "imports": F.array_distinct(F.concat(F.coalesce("imports", empty), F.coalesce("specs", empty))),
            "ai_hints": F.coalesce("ai_hints", empty),
        }
    ).drop("names", "specs")
    if config.bridge:
        table = table.join(bridge.counts(ast, provenance), "path", "left").fillna(0, ["explicit_count", "converted_count", "merged_count"])
    resolved = graph.resolve_imports(table.select(F.col("path").alias("importer"), F.explode("imports").alias("spec")), sources.select("path"))
    table = table.join(graph.imported_by(resolved), "path", "left").withColumn("imported_by", F.coalesce("imported_by", empty))
    if commits is not None:
        table = history.enrich(table, history.summary(history.newest(commits)))

    calls = files.call_edges(notes).select("caller", "callee", "path", "line_no").unionByName(parsers.calls(parsed).select("caller", "callee", "path", "line_no"))
    found = files.issues(notes)
    return Catalog(table, symbols, notes, provenance, calls, resolved, stats.lock_row(table), files.hacks(found), conventions.naming(sources.select("path")), parsers.errors(parsed))


def _bridged(symbols: DataFrame, sources: DataFrame, notes: DataFrame, config: Config) -> DataFrame:
    """Summaries, purposes and bridge of symbols: their doc comments' two sides by the configured precedence.

    Where a comment says nothing, what annotations in the code around the symbol say counts.
    """
    scoped = files.scoped(notes).where("symbol is not null")
    near = scoped.groupBy("path", F.col("symbol").alias("name")).agg(
        F.max_by(F.regexp_replace("value", '^"|"$', ""), F.when((F.col("name") == "summary") & (F.col("line_no") > F.col("symbol_line")), F.col("line_no"))).alias("noted"), F.max("opener_directive").alias("stated")
    )
    formats = sources.select("path", "language", bridge.detect(F.col("content"), F.col("language"), config.docstring_style).alias("format"))
    rows = symbols.withColumnRenamed("summary", "doc").join(formats, "path").withColumn("target", F.concat_ws("\x00", "path", "qualified_name", F.col("line_start").cast("string")))
    one = rows.dropDuplicates(["target"])  # a place holds one symbol of a name
    made = bridge.applied(one, config.precedence).join(near, ["path", "name"], "left")
    plain = doc_comments.column(F.col("doc"), doc_comments.style_of(F.col("language")))["summary"]
    summary = F.coalesce("summary", F.when(F.col("format").isNull() & F.col("doc").isNotNull(), plain), "noted")
    return made.withColumns({"summary": summary, "purpose": F.coalesce("directive", "stated")}).drop("language", "format", "target", "doc", "directive", "noted", "stated")


def index(spark: SparkSession, root: str, config: Config | None = None, with_git: bool = False) -> Catalog:
    """Scans a tree and builds its tables; a mounted folder is read with its hidden files and without listing what is excluded.

    Files above the configured size are not read; each has a row in ``problems``.
    """
    config = config or Config()
    scan = tree.scan if os.path.isdir(root) else source_files.scan
    sources = scan(spark, root, tuple(config.include), tuple(config.exclude), config.max_file_bytes)
    commits = git.read(spark, root) if with_git else None
    made = build(sources, config, commits)
    large = scan(spark, root, tuple(config.include), tuple(config.exclude), content=False).where(F.col("length") > config.max_file_bytes)
    made.problems = made.problems.unionByName(large.select("path", F.format_string("not read: %d bytes, at most %d are", "length", F.lit(config.max_file_bytes)).alias("problem")))
    return made
