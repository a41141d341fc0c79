"""Diffs by windows against difflib, and added annotations against a plain edit of the text."""

import difflib
import random

from pyspark.sql import functions as F

from srcatlas.operators import rewrite
from srcatlas.schema import MARKER as M


def test_hunks_equal_difflib(spark):
    chance, rows, wanted = random.Random(5), [], {}
    for f in range(60):
        n, path = chance.choice((0, 1, 2, 7, 8, 30, 60)), f"f{f}"
        old = [f"line {i} of {f}" for i in range(n)]
        new, place = [], 0
        share = chance.choice((0.02, 0.1, 0.4))
        for i in range(n + 1):
            for j in range(chance.randrange(3) if chance.random() < share else 0):
                new.append(f"added {i} {j} {f}")
                rows.append((path, place := place + 1, "+", new[-1]))
            if i < n and chance.random() < share:
                rows.append((path, place := place + 1, "-", old[i]))
                if chance.random() < 0.5:
                    new.append(f"changed {i} {f}")
                    rows.append((path, place := place + 1, "+", new[-1]))
            elif i < n:
                new.append(old[i])
                rows.append((path, place := place + 1, " ", old[i]))
        diff = "\n".join(difflib.unified_diff(old, new, f"a/{path}", f"b/{path}", lineterm="", n=3))
        if diff:
            wanted[path] = diff
    edited = spark.createDataFrame(rows, "path string, place int, sign string, text string").repartition(4)
    assert {r["path"]: r["diff"] for r in rewrite.hunks(edited).collect()} == wanted


def test_preview_equals_plain_edits(spark):
    chance, files, changes = random.Random(6), [], []
    for f in range(40):
        path, language = f"f{f}", chance.choice(("python", "go", "rust", "java", "typescript", None))
        lines = [" " * chance.randrange(5) + f"text {i}" for i in range(chance.randrange(1, 30))]
        lines[0] = f"/** {M}lock frozen"
        files.append((path, language, "\n".join(lines) + chance.choice(("", "\n"))))
        for at, line in enumerate(sorted(chance.sample(range(1, len(lines) + 2), min(len(lines), chance.randrange(1, 4))))):
            start = 1 if at == 0 and line > 3 and chance.random() < 0.5 else None  # a comment stands above its target
            changes.append((path, f"t{line:02}", line, line == 1, start, 2 if start else None, chance.choice(([f"{M}lock normal", f'{M}summary "x y"'], [f"{M}todo a"], []))))
    rows = spark.createDataFrame(files, "path string, language string, content string")
    listed = spark.createDataFrame(changes, "path string, target string, line long, is_file boolean, doc_start long, doc_end long, texts array<string>")
    got = {r["path"]: (r["content"], r["diff"]) for r in rewrite.preview(rows, listed).collect()}
    names = ("line", "is_file", "doc_start", "doc_end", "texts")
    for path, language, content in files:
        own = [dict(zip(names, c[2:], strict=True)) for c in changes if c[0] == path]
        after = rewrite.apply(content, language or "", own)
        assert got[path] == (after, rewrite.diff(content, after, path)), (path, language, own)


def test_empty_tables(spark):
    rows = spark.createDataFrame([("p", "go", "")], "path string, language string, content string")
    none = spark.createDataFrame([], "path string, target string, line long, is_file boolean, doc_start long, doc_end long, texts array<string>")
    assert rewrite.preview(rows, none).count() == 0
    one = none.union(spark.createDataFrame([("p", "t", 1, True, None, None, ["x"])], none.schema))
    assert rewrite.preview(rows, one).select("content", F.length("diff") > 0).collect() == [("// x", True)]
