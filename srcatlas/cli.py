"""Command line: thin wrappers around the operators."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import config as configuration
from .catalog import Catalog, index
from .functions.conditions import confidence
from .functions.paths import glob_regex
from .operators import analysis, annotations, constraints, contexts, conventions, documents_check, graph, history, lookups, rewrite, stats, suggestions, variables, writers
from .session import session
from .sources import git, tree
from .sources.documents import read_document
from .storage import written
from .streaming import watch


def show(rows: DataFrame, most: int = 100) -> None:
    """The first rows as lines of JSON."""
    for line in rows.limit(most).toJSON().toLocalIterator():
        print(line)


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="srcatlas", description=__doc__)
    made.add_argument("--catalog", default=".srcatlas", help="folder of the stored tables")
    made.add_argument("--config", default=".srcatlas.json")
    add = made.add_subparsers(dest="command", required=True).add_parser
    one = add("index", help="scan a tree and store its tables")
    one.add_argument("root", nargs="?", default=".")
    one.add_argument("--git", action="store_true")
    one.add_argument("--no-bridge", action="store_true")
    one = add("query", help="look something up")
    one.add_argument("what", choices=["symbol", "file", "callers", "callees", "domains", "domain", "hotpaths", "stats", "provenance", "search", "problems"])
    one.add_argument("name", nargs="?", default="")
    one = add("context", help="what to know before a task")
    one.add_argument("task", choices=["create", "modify", "debug", "explore"])
    one.add_argument("target", nargs="?", default="")
    one = add("check", help="constraints of a file, or of all by level")
    one.add_argument("path", nargs="?", default=".")
    one = add("review", help="annotations that need a review")
    one.add_argument("--source")
    one.add_argument("--confidence")
    one = add("map", help="folders and their files")
    one.add_argument("--depth", type=int, default=3)
    one = add("vars", help="generated variables")
    one = add("expand", help="expand variables in a text")
    one.add_argument("text", nargs="?", default="-")
    one.add_argument("--mode", default="summary", choices=variables.MODES)
    one = add("chain", help="what a variable refers to")
    one.add_argument("name")
    one = add("migrate", help="annotations without a directive: listed, as a diff, or rewritten with backups")
    one.add_argument("root", nargs="?", default=".")
    one.add_argument("--diff", action="store_true")
    one.add_argument("--apply", metavar="STAMP", help="rewrite the files; what they held is kept as path.STAMP.bak")
    one = add("annotate", help="what files lack: coverage, suggestions, a diff, or files rewritten with backups")
    one.add_argument("root", nargs="?", default=".")
    one.add_argument("--level", default="standard", choices=list(suggestions.LEVELS))
    one.add_argument("--least", type=float, default=0.0, metavar="CONFIDENCE")
    one.add_argument("--filter", metavar="GLOB", help="only files whose path below the root fits")
    one.add_argument("--git", action="store_true", help="suggestions from history too")
    one.add_argument("--provenance", metavar="ID", help="state the source of each annotation, and this run's id")
    one.add_argument("--coverage", action="store_true")
    one.add_argument("--diff", action="store_true")
    one.add_argument("--apply", metavar="STAMP", help="what the files held is kept as path.STAMP.bak")
    one.add_argument("--check", type=float, metavar="PERCENT", help="fail below this coverage")
    one = add("validate", help="what is wrong with stored documents; fails if anything is")
    one.add_argument("path")
    add("bridge", help="documentation formats, and annotations by where they come from, of every file")
    one = add("watch", help="index the annotations of what is new, changed or gone since the last run")
    one.add_argument("root", nargs="?", default=".")
    one = add("gate", help="fail below a share of documented symbols")
    one.add_argument("--least", type=float, default=configuration.Config().coverage_gate)
    return made


def query(held: Catalog, what: str, name: str) -> DataFrame:
    if what == "symbol":
        return contexts.symbol_report(lookups.symbol(held.symbols, name), graph.callers(held.calls), graph.callees(held.calls))
    if what == "search":
        return lookups.search(held.symbols, name)
    if what == "file":
        return contexts.file_report(lookups.file(held.files, name), held.symbols)
    if what == "callers":
        return held.calls.where(F.col("callee") == name).select("caller").distinct().orderBy("caller")
    if what == "callees":
        return held.calls.where(F.col("caller") == name).select("callee").distinct().orderBy("callee")
    if what == "domains":
        return stats.domains(held.files).orderBy("domain")
    if what == "domain":
        return lookups.in_domain(held.files, name).select("path").orderBy("path")
    if what == "hotpaths":
        return graph.hotpaths(held.calls)
    if what == "problems":
        return held.problems.orderBy("path")
    if what == "provenance":
        return stats.provenance_report(held.provenance)
    return stats.totals(held.files, held.symbols)


def context(held: Catalog, task: str, target: str) -> DataFrame:
    reverse = held.files.select("path", "imported_by")
    if task == "create":
        return contexts.create(held.files, held.conventions).where(F.col("folder") == target)
    if task == "modify":
        return contexts.modify(held.files, reverse, held.constraints).where(F.col("path") == target)
    if task == "debug":
        hot = graph.hotpaths(held.calls)
        if held.files.where(F.col("path") == target).isEmpty():
            return contexts.debug_symbol(held.files, lookups.symbol(held.symbols, target), hot)
        return contexts.debug(held.files, held.symbols, hot).where(F.col("path") == target)
    found = lookups.in_domain(held.files, target) if target else held.files
    return contexts.explore(found, held.symbols, graph.key_files(reverse))


def annotate(spark, given: argparse.Namespace, config: configuration.Config) -> int:
    """The analysis of a tree, and what is done about it."""
    sources = tree.scan(spark, given.root, tuple(config.include), tuple(config.exclude), config.max_file_bytes)
    if given.filter:
        sources = sources.where(F.col("path").rlike(glob_regex(given.filter)))
    found = analysis.analyze(sources, given.level)
    if given.check is not None:
        share = analysis.total(found.coverage).first()["coverage"]
        print(f"{share:.1f}")
        return int(share < given.check)
    if given.coverage:
        show(found.coverage.orderBy("path"))
        return 0
    past = None
    if given.git:
        now = datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
        past = history.summary(history.newest(git.read(spark, given.root))).withColumn("days", history.age_days(F.col("last_ts"), now))
    made = analysis.suggest(found.gaps, sources, given.level, given.least, past)
    if not (given.diff or given.apply):
        show(made.select("path", "line", "target", "kind", "value", "confidence", "source").orderBy("path", "line", "target", "kind"))
        return 0
    changes = analysis.changes(made, given.level, given.provenance is not None, given.provenance)
    edited = rewrite.script(sources, changes)
    if given.diff:
        for row in rewrite.hunks(edited).orderBy("path").toLocalIterator():
            print(row["diff"])
    else:
        # a file keeps the line end that it had, and files are read before any is written
        ends = sources.select("path", F.when(F.col("content").endswith("\n"), "\n").otherwise("").alias("end"))
        writers.put(written(rewrite.contents(edited).join(ends, "path").select("path", F.concat("content", "end").alias("content"))), given.root, given.apply)
    return 0


def main(arguments: list[str] | None = None) -> int:
    given = parser().parse_args(arguments)
    spark = session()
    config = configuration.load(given.config)
    if given.command == "index":
        config.bridge = config.bridge and not given.no_bridge
        index(spark, given.root, config, given.git).save(given.catalog)
        return 0
    if given.command == "migrate":
        sources = tree.scan(spark, given.root, tuple(config.include), tuple(config.exclude))
        if given.apply:
            writers.put(annotations.migrated(sources).select("path", F.col("after").alias("content")), given.root, given.apply)
        elif given.diff:
            for row in rewrite.hunks(annotations.migration_script(sources)).orderBy("path").toLocalIterator():
                print(row["diff"])
        else:
            show(annotations.legacy(annotations.lines(sources)))
        return 0
    if given.command == "annotate":
        return annotate(spark, given, config)
    if given.command == "validate":
        wrong = documents_check.check(read_document(spark, given.path).withColumnRenamed("file", "name")).persist()
        show(wrong.orderBy("name", "spot", "message"))
        failed = not wrong.isEmpty()
        wrong.unpersist()  # else the next call would find these rows for files that have changed
        return int(failed)
    if given.command == "watch":
        where = given.catalog.rstrip("/")
        watch.watch(spark, given.root, f"{where}/watched", f"{where}/watched_log", tuple(config.include), tuple(config.exclude)).awaitTermination()
        return 0
    held = Catalog.load(spark, given.catalog)
    if given.command == "query":
        show(query(held, given.what, given.name))
    elif given.command == "context":
        show(context(held, given.task, given.target))
    elif given.command == "check":
        show(constraints.check_report(held.constraints) if given.path == "." else lookups.file(held.constraints, given.path))
    elif given.command == "bridge":
        columns = [c for c in ("explicit_count", "converted_count", "merged_count") if c in held.files.columns]  # none without the bridge
        show(held.files.select("path", "detected_format", *columns).orderBy("path"))
    elif given.command == "review":
        if given.confidence:
            confidence(given.confidence, F.col("confidence"))
        show(lookups.review_queue(held.provenance, given.source, given.confidence))
    elif given.command == "map":
        show(conventions.tree(held.files, given.depth).orderBy("folder"))
    elif given.command in ("vars", "expand", "chain"):
        made = variables.generate(held.symbols, held.files, held.calls)
        if given.command == "vars":
            show(made.orderBy("name"))
        elif given.command == "expand":
            text = sys.stdin.read() if given.text == "-" else given.text
            show(variables.expand_texts(spark.createDataFrame([(0, text)], "id long, text string"), made, given.mode))
        else:
            show(variables.inheritance(made, made.where(F.col("name") == given.name)))
    elif given.command == "gate":
        found = stats.totals(held.files, held.symbols).first()["coverage"]
        print(f"{found:.1f}")
        return int(found < given.least)
    return 0


if __name__ == "__main__":
    sys.exit(main())
