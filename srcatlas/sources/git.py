"""Version-control facts of one repository as Spark data sources.

The log is read in ranges of ``COMMITS`` from the commit that HEAD names when
the query starts, and filters on path and time reach git; blame takes a command
a file, dealt out in lists of ``BLAMED``; the status is one command.  As a
stream, the log's offset is a commit, so new commits arrive once.  The
repository must be checked out at the same path wherever tasks run.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition

#: Commits that one task reads.
COMMITS = 2000
#: Files that one task blames.
BLAMED = 64
LOG = "path string, commit_id string, author string, email string, ts timestamp, message string, added long, removed long"
BLAME = "path string, line_no long, commit_id string, author string, email string, ts timestamp, summary string"
STATUS = "path string, status string"


def run(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, "-c", "core.quotepath=off", *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")


def log_rows(repo: str, *selected: str) -> Iterator[tuple]:
    """One row per commit and changed path, against the first parent, without renames; paths as they are.

    Fields and entries end in NUL, which no name, subject or path can hold.
    """
    parts = selected or ("HEAD",)
    facts = run(repo, "log", "-z", "--date-order", "--format=%H%x00%an%x00%ae%x00%ct%x00%s", *parts).split("\0")
    about = {facts[at]: facts[at + 1 : at + 5] for at in range(0, len(facts) - 4, 5)}
    commit = ""
    for token in run(repo, "log", "-z", "--date-order", "--diff-merges=first-parent", "--no-renames", "--numstat", "--format=%H", *parts).split("\0"):
        token = token.lstrip("\n")
        if token.count("\t") < 2:  # a change has two tabs before its path, a commit none
            commit = token or commit
            continue
        added, removed, path = token.split("\t", 2)
        author, email, seconds, message = about[commit]
        yield path, commit, author or "Unknown", email, datetime.fromtimestamp(int(seconds), UTC), message, int(added) if added != "-" else 0, int(removed) if removed != "-" else 0


def tracked(repo: str) -> list[str]:
    """The paths that the index holds."""
    return [p for p in run(repo, "ls-files", "-z").split("\0") if p]


def committed(repo: str) -> list[str]:
    """The files that HEAD holds, without submodules."""
    entries = (e.split("\t", 1) for e in run(repo, "ls-tree", "-r", "-z", "HEAD").split("\0") if e)
    return [path for facts, path in entries if facts.split()[1] == "blob"]


def is_tracked(repo: str, path: str) -> bool:
    return path in tracked(repo)


def tip(repo: str) -> str:
    """The commit that HEAD names, or nothing before the first one."""
    found = subprocess.run(["git", "-C", repo, "rev-parse", "--verify", "-q", "HEAD"], capture_output=True)
    return found.stdout.decode().strip()


def blame_rows(repo: str, paths: list[str]) -> Iterator[tuple]:
    for path in paths:
        facts: dict[str, str] = {}
        for line in run(repo, "blame", "-C", "--line-porcelain", "HEAD", "--", path).split("\n"):
            if line.startswith("\t"):
                when = datetime.fromtimestamp(int(facts.get("author-time", 0)), UTC)
                yield path, int(facts["line"]), facts["commit"], facts.get("author") or "Unknown", facts.get("author-mail", "").strip("<>"), when, facts.get("summary", "")
                facts = {}
                continue
            key, _, value = line.partition(" ")
            if len(key) == 40 and all(c in "0123456789abcdef" for c in key):
                facts = {"commit": key, "line": value.split()[1]}
            elif key:
                facts[key] = value


# What the two letters of a status mean, first match first.
_STATES = (
    (("DD", "AU", "UD", "UA", "DU", "AA", "UU"), "conflicted"), (("!!",), "ignored"), (("??",), "untracked"),
    (("A ", "AM"), "staged_new"), ((" D", "D "), "deleted"), (("M ", "R ", "C "), "staged"), ((" M", "MM"), "modified"),
)


def status_rows(repo: str) -> Iterator[tuple]:
    """path and state; a renamed or copied file under its new path."""
    entries = iter(run(repo, "status", "--porcelain", "-z").split("\0"))
    for entry in entries:
        if len(entry) > 3:
            if entry[0] in "RC" or entry[1] in "RC":
                next(entries, None)  # the path it came from
            yield entry[3:], next((name for codes, name in _STATES if entry[:2] in codes), "modified")


class _Paths(InputPartition):
    """The files that one task blames."""

    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class _Range(InputPartition):
    """What one task's log is asked for."""

    def __init__(self, selected: list[str]):
        super().__init__(0)
        self.selected = selected


def ranges(repo: str, since: list[str], paths: list[str], size: int) -> list[_Range]:
    """The log from a fixed commit, cut into ranges; ``since`` are further options and revisions."""
    behind = ["--", *[f":(top,literal){p}" for p in paths]] if paths else ["--"]
    count = int(run(repo, "rev-list", "--count", *since, *behind))
    return [_Range([f"--skip={at}", f"--max-count={size}", *since, *behind]) for at in range(0, count, size)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.wanted: list[str] | None = None
        self.after: list[str] = []

    def pushFilters(self, filters):
        """Paths and the earliest time reach git, which may give a little more; Spark applies all filters again."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("path",):
                found = [v for v in ([f.value] if isinstance(f, EqualTo) else f.value) if v]
                self.wanted = found if self.wanted is None else [p for p in self.wanted if p in found]
            elif isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("ts",) and isinstance(f.value, datetime):
                self.after = [f"--since-as-filter={int(f.value.timestamp()) - 86_400}"]  # a day for time zones
            yield f

    def partitions(self) -> list[InputPartition]:
        repo, kind = self.options["path"], self.options.get("table", "log")
        if kind == "status":
            return [InputPartition(0)]
        at = tip(repo)
        if not at or self.wanted == []:
            return []
        if kind == "log":
            return ranges(repo, [*self.after, at], self.wanted or [], int(self.options.get("commitspertask", COMMITS)))
        known = committed(repo)
        asked = {p for p in self.options.get("only", "").split("\n") if p} or set(known)
        paths = [p for p in known if p in asked and (self.wanted is None or p in self.wanted)]
        size = int(self.options.get("filespertask", BLAMED))
        return [_Paths(paths[at : at + size]) for at in range(0, len(paths), size)]

    def read(self, partition) -> Iterator[tuple]:
        repo = self.options["path"]
        if isinstance(partition, _Paths):
            return blame_rows(repo, partition.paths)
        return log_rows(repo, *partition.selected) if isinstance(partition, _Range) else status_rows(repo)


class _Stream(DataSourceStreamReader):
    """The log of what each batch adds: commits that the new tip reaches and the old one does not."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"commit": ""}

    def latestOffset(self) -> dict:
        return {"commit": tip(self.options["path"])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["commit"] == end["commit"]:
            return []
        since = [end["commit"], *([f"^{start['commit']}"] if start["commit"] else [])]
        return ranges(self.options["path"], since, [], int(self.options.get("commitspertask", COMMITS)))

    def read(self, partition) -> Iterator[tuple]:
        return log_rows(self.options["path"], *partition.selected)


class GitSource(DataSource):
    """``spark.read.format("git").option("table", "log" | "blame" | "status").load(repository)``."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return {"log": LOG, "blame": BLAME, "status": STATUS}[self.options.get("table", "log")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def read(spark: SparkSession, repo: str, table: str = "log", paths: list[str] | None = None, **options: str) -> DataFrame:
    """A table of the repository; ``paths`` names the files to blame (those of HEAD, if there are none)."""
    if paths is not None:
        options["only"] = "\n".join(paths)
    spark.dataSource.register(GitSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("git").option("table", table).options(**options).load(repo)


def new_commits(spark: SparkSession, repo: str, **options: str) -> DataFrame:
    """The log as a stream: all of it, then what is new."""
    spark.dataSource.register(GitSource)
    return spark.readStream.format("git").options(**options).load(repo)


def head(repo: str) -> dict[str, str | bool | None]:
    """HEAD, branch, remote, and whether there are changes."""
    try:
        remote = run(repo, "remote", "get-url", "origin").strip()
    except subprocess.CalledProcessError:
        remote = None
    commit = run(repo, "rev-parse", "HEAD").strip()
    branch = run(repo, "rev-parse", "--abbrev-ref", "HEAD").strip()
    return {"commit": commit, "short": commit[:7], "branch": None if branch == "HEAD" else branch, "remote": remote, "dirty": any(status_rows(repo))}
