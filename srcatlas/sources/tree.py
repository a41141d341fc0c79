"""A source tree as a Spark data source: folders are dealt out to tasks, and excluded ones are never listed.

The driver lists folders breadth first until there are ``SPLITS`` of them to
deal out, and the files of a large one in shares; the tasks list the rest.  A folder is passed over if an exclude glob
takes everything below it, or if neither an include glob's literal beginning
nor a pushed filter on the path can match below it; files go by globs, path and
length before they are read.

Cases: what cannot be listed has no rows; a file that cannot be read has no
content; names that are no UTF-8 get replacement characters; a link that leads
back to a folder above it is not followed; an empty or missing folder gives no
rows.  The tree must be at the same path wherever tasks run.
"""

from __future__ import annotations

import json
import math
import os
import re
import stat
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from ..functions.paths import glob_regex, language
from ..schema import EXCLUDE, INCLUDE

#: Folders that the driver deals out at most, each to a task.
SPLITS = 256
#: Entries of a folder that one task reads.
SHARE = 10_000
FILES = "path string, modified_at timestamp, length long, content string"
FOLDERS = "path string, files long, folders long"


def _shown(name: str) -> str:
    return os.fsencode(name).decode("utf-8", "replace")


def _patterns(globs: list[str]) -> list[re.Pattern]:
    return [re.compile("(?s)" + glob_regex(g)[:-1] + r"\Z") for g in globs]


def _beginning(glob: str) -> str:
    """What every path that the glob matches starts with."""
    return re.match(r"[^*?\[]*", glob).group()


@dataclass
class Choice:
    """Which folders to list and which files to take; globs see the path below the root, or the whole one with ``whole``."""

    root: str
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    wanted: str | None = None
    follow: bool = False
    whole: bool = False
    max_bytes: int | None = None
    #: For each pushed filter its alternatives: a text, and whether it is all of the path or its beginning.
    pushed: list[list[tuple[str, bool]]] = field(default_factory=list)

    def __post_init__(self):
        self._include, self._exclude = _patterns(self.include), _patterns(self.exclude)
        self._wanted = _patterns([self.wanted] if self.wanted else [])
        self._below = _patterns([g for g in self.exclude if g.endswith("*")])
        self._heads = [_beginning(g) for g in self.include]

    def _seen(self, rel: str) -> str:
        return f"{self.root.rstrip('/')}/{rel}" if self.whole else rel

    def folder(self, rel: str) -> bool:
        """Whether a file that counts can lie below the folder."""
        below = f"{_shown(rel)}/"
        meets = lambda at, head: at.startswith(head) or head.startswith(at)
        seen = self._seen(below)
        if any(p.match(seen) for p in self._below) or (self._heads and not any(meets(seen, head) for head in self._heads)):
            return False
        return all(any(meets(below, text) for text, _ in either) for either in self.pushed)

    def file(self, rel: str) -> bool:
        seen, shown = self._seen(_shown(rel)), _shown(rel)
        if self._include and not any(p.match(seen) for p in self._include) or any(p.match(seen) for p in self._exclude) or any(not p.match(seen) for p in self._wanted):
            return False
        return all(any(shown == text if exact else shown.startswith(text) for text, exact in either) for either in self.pushed)


class _Part(InputPartition):
    """A folder, the identities of those above it, whether to go on below it, and which of its files: all, or a share of them by name."""

    def __init__(self, rel: str, above: frozenset, deep: bool, share: tuple[int, int] = (0, 1)):
        super().__init__(0)
        self.rel, self.above, self.deep, self.share = rel, above, deep, share


def _entries(choice: Choice, rel: str) -> Iterator[tuple[str, os.DirEntry, bool]]:
    """Path, entry and whether it is a folder of what lies in a folder, read as it is asked for."""
    try:
        with os.scandir(os.path.join(choice.root, rel)) as found:
            for entry in found:
                yield f"{rel}/{entry.name}" if rel else entry.name, entry, entry.is_dir(follow_symlinks=choice.follow)
    except OSError:
        return


def _over(choice: Choice, rel: str, above: frozenset) -> frozenset:
    try:
        own = os.stat(os.path.join(choice.root, rel))
    except OSError:
        return above
    return above | {(own.st_dev, own.st_ino)}


def _facts(choice: Choice, entry: os.DirEntry) -> os.stat_result | None:
    try:
        return entry.stat(follow_symlinks=choice.follow)
    except OSError:
        return None


def _goes_on(choice: Choice, path: str, entry: os.DirEntry, above: frozenset) -> bool:
    if not choice.folder(path):
        return False
    facts = _facts(choice, entry)
    return facts is not None and not (entry.is_symlink() and (facts.st_dev, facts.st_ino) in above)


def walk(choice: Choice, rel: str = "", above: frozenset = frozenset(), deep: bool = True, told: Callable | None = None, share: tuple[int, int] = (0, 1)) -> Iterator[tuple[str, os.stat_result]]:
    """Files below a folder, one entry in memory at a time; ``told`` hears of every folder listed."""
    ahead = [(rel, above)]
    turn, shares = share
    while ahead:
        at, over = ahead.pop()
        over, files, folders = _over(choice, at, over), 0, 0
        for path, entry, is_folder in _entries(choice, at):
            if is_folder:
                if _goes_on(choice, path, entry, over):
                    folders += 1
                    if deep:
                        ahead.append((path, over))
            elif shares == 1 or zlib.crc32(os.fsencode(entry.name)) % shares == turn:
                facts = _facts(choice, entry)
                if facts and (choice.follow or stat.S_ISREG(facts.st_mode)) and choice.file(path) and (choice.max_bytes is None or facts.st_size <= choice.max_bytes):
                    files += 1
                    yield path, facts
        if told:
            told(at, files, folders)


def dealt(choice: Choice, splits: int, most: int | None = None) -> list[_Part]:
    """The tree as parts: folders of the upper levels alone, in shares of about ``most`` entries if given, and whole folders below them."""
    alone, ahead = [], deque([_Part("", frozenset(), True)])
    listed = 0
    while ahead and listed + len(ahead) < splits:
        part = ahead.popleft()
        over, entries, listed = _over(choice, part.rel, part.above), 0, listed + 1
        for path, entry, is_folder in _entries(choice, part.rel):
            if not is_folder:
                entries += 1
            elif _goes_on(choice, path, entry, over):
                ahead.append(_Part(path, over, True))
        shares = 1 if most is None else max(1, math.ceil(entries / most))
        alone += [_Part(part.rel, part.above, False, (turn, shares)) for turn in range(shares)]
    return [*ahead, *alone]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.pushed: list[list[tuple[str, bool]]] = []
        self.most: int | None = int(options["maxbytes"]) if "maxbytes" in options else None

    def pushFilters(self, filters):
        """Filters on path and length decide what is listed and read; Spark applies all of them again."""
        for f in filters:
            if f.attribute == ("path",) and isinstance(f, EqualTo | In):
                self.pushed.append([(v, True) for v in ([f.value] if isinstance(f, EqualTo) else f.value) if v is not None])
            elif f.attribute == ("path",) and isinstance(f, StringStartsWith):
                self.pushed.append([(f.value, False)])
            elif f.attribute == ("length",) and isinstance(f, LessThan | LessThanOrEqual):
                self.most = f.value if self.most is None else min(self.most, f.value)
            yield f

    def choice(self) -> Choice:
        o = self.options
        yes = lambda name: o.get(name, "false").lower() == "true"
        return Choice(o["path"], json.loads(o.get("include", "[]")), json.loads(o.get("exclude", "[]")), o.get("wanted"), yes("follow"), yes("whole"), self.most, self.pushed)

    def partitions(self) -> list[InputPartition]:
        # a folder's own row is made by one task
        most = None if self.options.get("table") == "folders" else SHARE
        return dealt(self.choice(), int(self.options.get("splits", SPLITS)), most)

    def read(self, partition: _Part) -> Iterator[tuple]:
        choice = self.choice()
        if self.options.get("table") == "folders":
            found: list[tuple] = []
            for _ in walk(choice, partition.rel, partition.above, partition.deep, lambda at, n, m: found.append((_shown(at), n, m))):
                while found:
                    yield found.pop()
            yield from found
            return
        contents = self.options.get("content", "true").lower() == "true"
        for rel, facts in walk(choice, partition.rel, partition.above, partition.deep, share=partition.share):
            text = _text(os.path.join(choice.root, rel), facts) if contents else None
            yield _shown(rel), datetime.fromtimestamp(facts.st_mtime, UTC), facts.st_size, text


def _text(path: str, facts: os.stat_result) -> str | None:
    try:
        if stat.S_ISREG(facts.st_mode):
            with open(path, "rb") as f:
                return f.read().decode("utf-8", "replace")
    except OSError:
        pass
    return None


class TreeSource(DataSource):
    """``spark.read.format("source_tree").option("include", '["**/*.py"]').load(folder)``: files, or the ``folders`` listed."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return FOLDERS if self.options.get("table") == "folders" else FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), **options: str) -> DataFrame:
    """The source's table; further options are ``table``, ``content``, ``follow``, ``whole``, ``wanted``, ``maxBytes`` and ``splits``."""
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("source_tree").options(include=json.dumps(list(include)), exclude=json.dumps(list(exclude)), **options).load(root)


def scan(spark: SparkSession, root: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE, max_bytes: int | None = None, content: bool = True) -> DataFrame:
    """What ``files.scan`` gives for a folder of this machine's file system, without listing what is excluded."""
    most = {} if max_bytes is None else {"maxBytes": str(max_bytes)}
    rows = read(spark, root, include, exclude, content=str(content), **most)
    columns = ["path", "modified_at", "length", language(F.col("path")).alias("language")]
    return rows.select(*columns, *(["content"] if content else []))


def to_annotate(spark: SparkSession, root: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE, wanted: str | None = None) -> DataFrame:
    """The files that annotating looks at: links are followed, globs see the whole path, and no include glob means no file."""
    more = {"wanted": wanted} if wanted else {}
    rows = read(spark, root, include, exclude, content="false", follow="true", whole="true", **more)
    kept = rows if include else rows.where(F.lit(False))
    return kept.select(F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("path"), "modified_at", "length")
