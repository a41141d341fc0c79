"""Symbols, imports and calls of source texts, language by language."""

from __future__ import annotations

import multiprocessing
from concurrent.futures import ProcessPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import braces, python

SYMBOLS = "path string, name string, qualified_name string, kind string, line_start long, line_end long, visibility string, exported boolean, doc string, signature string, async boolean, parent string"
IMPORTS = "path string, source string, names array<string>, line_no long"
CALLS = "path string, caller string, callee string, receiver string, line_no long"
SCHEMA = "path string, what string, name string, qualified_name string, kind string, line_start long, line_end long, visibility string, exported boolean, doc string, signature string, async boolean, parent string, names array<string>"
#: What ``nested`` adds to a file: the rows without their path.
ROWS = f"array<struct<{SCHEMA.removeprefix('path string, ').replace(' ', ':').replace(',:', ',')}>>"
_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_COLUMNS = {name: _ARROW[kind] for name, kind in (c.strip().split() for c in SCHEMA.split(", "))}
#: Files whose rows a task holds at once.
FILES = 500
#: So many times a child process parses ``FILES`` files before another takes its place.
CHILD = 40
EVERY = braces.EVERY


def extract(content: str, language: str, wanted: frozenset[str] = EVERY) -> list[dict]:
    """Rows of one file; a file that cannot be parsed has one that says why."""
    try:
        return python.extract(content, wanted) if language == "python" else braces.extract(content, language, wanted)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [{"what": "error", "name": f"{type(e).__name__}: {e}"}]


def _extracted(part: tuple[list, list, list, frozenset[str]]) -> list[tuple]:
    """Path and row of everything in some files."""
    names, languages, contents, kinds = part
    return [(p, r) for p, g, c in zip(names, languages, contents, strict=True) for r in extract(c or "", g or "", kinds)]


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r.get(c) for _, r in rows], kind) for c, kind in list(_COLUMNS.items())[1:]]


def _batch(part: tuple[list, list, list, frozenset[str]]) -> pa.RecordBatch:
    """The rows as a batch, which comes back from a child process in a few pieces."""
    rows = _extracted(part)
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), *_columns(rows)], list(_COLUMNS))


def _lists(part: tuple[list, list, list, frozenset[str]]) -> pa.Array:
    """The rows of every file as one list; files are told apart by their places, whatever their paths."""
    rows = _extracted((range(len(part[0])), *part[1:]))
    ends = np.cumsum(np.bincount(np.array([at for at, _ in rows], np.int64), minlength=len(part[0])))
    values = pa.StructArray.from_arrays(_columns(rows), list(_COLUMNS)[1:])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), values)


class _Parser:
    """Parses some files at a time; those with Python sources in a child process that ends after ``CHILD`` times.

    The language's parser keeps every name that it has met until its process
    ends, so a worker that lives on would grow with the files of all its tasks.
    """

    def __init__(self):
        self.pool, self.times = None, 0

    def rows(self, part: tuple[list, list, list, frozenset[str]]) -> list[tuple]:
        return self.run(_extracted, part)

    def run(self, made, part: tuple[list, list, list, frozenset[str]]):
        """What ``made`` makes of some files."""
        if "python" not in part[1]:
            return made(part)
        if self.times % CHILD == 0:
            self.close()
            self.pool = ProcessPoolExecutor(1, multiprocessing.get_context("fork"))
        self.times += 1
        # fails, and does not wait, if the child is gone
        return self.pool.submit(made, part).result()

    def close(self) -> None:
        if self.pool is not None:
            self.pool.shutdown()


def parse(files: DataFrame, *wanted: str) -> DataFrame:
    """Rows (symbols, imports, calls, errors) of path, language and content, in Arrow batches.

    ``wanted``: ``symbol``, ``import``, ``call``; without any, all of them.
    Errors always have rows.
    """
    kinds = frozenset(wanted) or EVERY

    def run(batches):
        parser = _Parser()
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, FILES):
                    part = [c.to_pylist() for c in batch.slice(start, FILES).columns]
                    yield parser.run(_batch, (*part, kinds))
        finally:
            parser.close()

    return files.select("path", "language", "content").mapInArrow(run, SCHEMA)


def nested(files: DataFrame, *wanted: str) -> DataFrame:
    """path, language and content of every file, and the rows of ``parse`` as one array ``parsed``: what is made of them needs no shuffle."""
    kinds = frozenset(wanted) or EVERY

    def run(batches):
        parser = _Parser()
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, FILES):
                    part = batch.slice(start, FILES)
                    lists = parser.run(_lists, (*[c.to_pylist() for c in part.columns], kinds))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], ["path", "language", "content", "parsed"])
        finally:
            parser.close()

    return files.select("path", "language", "content").mapInArrow(run, f"path string, language string, content string, parsed {ROWS}")


def symbols(rows: DataFrame) -> DataFrame:
    return rows.where("what = 'symbol'").drop("what", "names")


def imports(rows: DataFrame) -> DataFrame:
    return rows.where("what = 'import'").select("path", F.col("name").alias("source"), "names", F.col("line_start").alias("line_no"))


def calls(rows: DataFrame) -> DataFrame:
    return rows.where("what = 'call'").select("path", F.col("parent").alias("caller"), F.col("name").alias("callee"), F.col("qualified_name").alias("receiver"), F.col("line_start").alias("line_no"))


def errors(rows: DataFrame) -> DataFrame:
    """path and problem of files that could not be parsed."""
    return rows.where("what = 'error'").select("path", F.col("name").alias("problem"))
