"""Writers that put new contents in place: annotated sources, migrations with backups, restored files.

``put`` stages all files first and moves them when every task has staged its
own, so a failed task leaves the tree as it was.  ``write_files`` writes as its
rows are evaluated and tells what it did.

The files are written by the tasks that hold their contents, below a folder
that all of them share.  A file is written beside its place and then moved
there, so a lost task leaves no half-written one and may be repeated.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: The paths of a staged folder's files, in their order.
LIST = "paths"
WRITTEN = "path string, written boolean, backup string"


def replace(path: str, content: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    beside = f"{path}.{os.getpid()}.new"
    with open(beside, "w", encoding="utf-8", newline="") as f:
        f.write(content)
    os.replace(beside, path)


def write_files(contents: DataFrame, root: str, stamp: str | None = None) -> DataFrame:
    """Writes (path, content) below ``root``; path, whether something changed, and the backup.

    With a ``stamp`` an existing file of other content is kept beside it as
    ``path.stamp.bak``; a backup that is there already stays, so a repeated task
    does not replace it by what it wrote.  Unchanged files are not touched.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                full, backup = os.path.join(root, path), None
                if os.path.commonpath([os.path.realpath(full), os.path.realpath(root)]) != os.path.realpath(root):
                    raise ValueError(f"{path!r} is not below {root!r}")
                before = None
                if os.path.exists(full):
                    with open(full, encoding="utf-8", errors="replace", newline="") as f:
                        before = f.read()
                if before != content:
                    if stamp and before is not None:
                        backup = f"{path}.{stamp}.bak"
                        if not os.path.exists(os.path.join(root, backup)):
                            replace(os.path.join(root, backup), before)
                    replace(full, content)
                rows.append((path, before != content, backup))
            yield pd.DataFrame(rows, columns=["path", "written", "backup"])

    return contents.select("path", "content").where("content is not null").mapInPandas(run, WRITTEN)


def restore(files: DataFrame, root: str) -> DataFrame:
    """Writes the stored contents of an attempt or a checkpoint (path, content) back; without content a file stays as it is."""
    return write_files(files, root)


def below(root: str, path: str) -> str:
    full = os.path.join(root, path)
    if os.path.commonpath([os.path.realpath(full), os.path.realpath(root)]) != os.path.realpath(root):
        raise ValueError(f"{path!r} is not below {root!r}")
    return full


def text_at(path: str) -> str | None:
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8", errors="replace", newline="") as f:
        return f.read()


def _stage(contents: DataFrame, root: str, stage: str) -> list[str]:
    """Writes what differs into folders of their own, one a task, each with a list of its paths; those folders."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, n = os.path.join(stage, uuid.uuid4().hex), 0
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                if text_at(below(root, path)) != content:
                    if not n:
                        os.makedirs(own)
                        listed = open(os.path.join(own, LIST), "w", encoding="utf-8")
                    with open(os.path.join(own, str(n)), "w", encoding="utf-8", newline="") as f:
                        f.write(content)
                    listed.write(json.dumps(path) + "\n")
                    n += 1
        if n:
            listed.close()
            yield pd.DataFrame({"folder": [own]})

    rows = contents.select("path", "content").where("content is not null").mapInPandas(run, "folder string")
    return [r["folder"] for r in rows.collect()]  # a row a task


def _staged(folder: str) -> Iterator[tuple[str, str]]:
    """Path and staged file of everything in a folder."""
    with open(os.path.join(folder, LIST), encoding="utf-8") as f:
        for n, line in enumerate(f):
            yield json.loads(line), os.path.join(folder, str(n))


def _keep(root: str, folder: str, stamp: str) -> None:
    for path, staged in _staged(folder):
        full = below(root, path)
        backup = f"{full}.{stamp}.bak"
        if os.path.exists(staged) and os.path.exists(full) and not os.path.exists(backup):
            replace(backup, text_at(full))


def _move(root: str, folder: str) -> None:
    """Every file by one move; a second attempt moves what the first one left."""
    for path, staged in _staged(folder):
        full = below(root, path)
        if os.path.exists(staged):
            os.makedirs(os.path.dirname(full), exist_ok=True)
            os.replace(staged, full)


def _each(folders: DataFrame, step: Callable[[str], None]) -> None:
    """Runs a step on every folder, in a task for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["folder"]:
                step(folder)
            yield batch

    folders.mapInPandas(run, "folder string").write.format("noop").mode("overwrite").save()


def put(contents: DataFrame, root: str, stamp: str | None = None) -> None:
    """Writes all of (path, content) below ``root``, or nothing; with a ``stamp`` replaced files are kept as ``path.stamp.bak``.

    Backups come first, then the moves; both are made by tasks, and the driver only hears of a folder from each.
    """
    spark = contents.sparkSession
    stage = os.path.join(root, f".staged-{uuid.uuid4().hex}")
    try:
        found = _stage(contents, root, stage)
        if found:
            folders = spark.createDataFrame([(f,) for f in found], "folder string").repartition(len(found))
            if stamp:
                _each(folders, lambda folder: _keep(root, folder, stamp))
            _each(folders, lambda folder: _move(root, folder))
    finally:
        shutil.rmtree(stage, ignore_errors=True)
