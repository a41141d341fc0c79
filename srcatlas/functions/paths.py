"""Paths as columns: canonical form, parts, language, glob filters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EXTENSIONS


def normalize(path: Column) -> Column:
    """Forward slashes, no empty or ``.`` parts, ``..`` removes its parent; never starts with a slash."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    kept = F.filter(parts, lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p)),
    )
    return F.array_join(folded, "/")


def parent(path: Column) -> Column:
    """The folder of a path, empty for a bare file name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot belongs to the name."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def language(path: Column) -> Column:
    """The language of a file name, or null."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(known, extension(path))


def glob_regex(glob: str) -> str:
    """A glob as a regular expression; ``*`` and ``?`` cross slashes, ``**/`` also matches nothing."""
    out, at = [], 0
    while at < len(glob):
        if glob.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 3
        elif glob[at] == "*":
            while glob[at : at + 1] == "*":
                at += 1
            out.append(".*")
        elif glob[at] == "?":
            out.append(".")
            at += 1
        elif glob[at] == "[" and "]" in glob[at + 2 :]:
            end = glob.index("]", at + 2)
            body = glob[at + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]")
            at = end + 1
        else:
            out.append(re.escape(glob[at]))
            at += 1
    return "^" + "".join(out) + "$"


def selected(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """True for paths that an include glob matches (any path if there is none) and no exclude glob does."""
    keep = F.lit(True)
    if include:
        keep = path.rlike("|".join(glob_regex(g) for g in include))
    if exclude:
        keep = keep & ~path.rlike("|".join(glob_regex(g) for g in exclude))
    return keep


# Parts of paths that make a file a test.
TEST_PARTS = ("/test/", "/tests/", "/__tests__/", "/spec/", "/e2e/", ".test.", ".spec.", "_test.", "_spec.")


def is_test(path: Column) -> Column:
    """Paths of tests, by folder or by file name."""
    found = F.lit(False)
    for part in TEST_PARTS:
        found = found | F.lower(path).contains(part)
    return found
