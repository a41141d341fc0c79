"""Git, the watch loop and the tree sink: hard names, ranges, new commits, lost tasks."""

import subprocess
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from srcatlas.operators import writers
from srcatlas.schema import MARKER as M
from srcatlas.sources import git
from srcatlas.streaming import watch


@pytest.fixture
def repo(tmp_path):
    where = tmp_path / "repo"
    where.mkdir()

    def run(*args):
        subprocess.run(["git", "-C", str(where), "-c", "user.name=A\x1fB", "-c", "user.email=a@b.c", *args], check=True, capture_output=True)

    def commit(name, text, subject):
        (where / name).write_text(text)
        run("add", name)
        run("commit", "-q", "-m", subject)

    run("init", "-q", "-b", "main")
    return str(where), run, commit


def test_log_in_ranges_with_control_characters(spark, repo):
    where, _, commit = repo
    assert git.read(spark, where).count() == 0
    for i in range(7):
        commit(f"f{i % 3}.py", f"line {i}\n", f"subject {i} \x1f and \x1e")
    rows = git.read(spark, where, commitsPerTask="2")
    assert rows.rdd.getNumPartitions() == 4
    assert sorted((r["path"], r["message"]) for r in rows.collect()) == sorted((f"f{i % 3}.py", f"subject {i} \x1f and \x1e") for i in range(7))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, git.read(spark, where).collect()))
    one = rows.where("path = 'f0.py'")
    assert one.count() == 3 and one.rdd.getNumPartitions() == 2
    assert rows.where("path in ('f1.py', 'none') and ts > timestamp '2001-01-01'").count() == 2
    assert rows.where("ts > timestamp '2100-01-01'").count() == 0


def test_blame_of_what_head_holds(spark, repo):
    where, run, commit = repo
    commit("a.py", "1\n2\n", "first")
    (Path(where) / "staged.py").write_text("x\n")
    run("add", "staged.py")
    assert "staged.py" in git.tracked(where) and git.committed(where) == ["a.py"]
    assert sorted((r["path"], r["line_no"]) for r in git.read(spark, where, "blame").collect()) == [("a.py", 1), ("a.py", 2)]
    assert git.read(spark, where, "blame", paths=["staged.py", "a.py"]).count() == 2


def test_new_commits_arrive_once(spark, repo, tmp_path):
    where, _, commit = repo
    out, log = str(tmp_path / "out"), str(tmp_path / "log")

    def run():
        stream = git.new_commits(spark, where, commitsPerTask="2").writeStream.format("parquet").option("path", out).option("checkpointLocation", log)
        query = stream.trigger(once=True).start()
        assert query.awaitTermination(60) and query.exception() is None
        return sorted(r["message"] for r in spark.read.parquet(out).collect())

    for i in range(3):
        commit("a.py", f"{i}\n", f"c{i}")
    assert run() == ["c0", "c1", "c2"]
    commit("b.py", "new\n", "c3")
    assert run() == ["c0", "c1", "c2", "c3"]
    assert run() == ["c0", "c1", "c2", "c3"]


def test_watch_with_own_globs(spark, tmp_path, monkeypatch):
    root, target, log = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "log")
    root.mkdir()
    for name in ("a.zz", "b.zz", "c.zz", "d.ts"):
        (root / name).write_text(f"// {M}domain {name[0]}\n")
    own = {"include": ("**/*.zz",)}
    watch.watch(spark, str(root), target, log, **own).awaitTermination(60)
    held = lambda: {r["value"] for r in watch._existing(spark, target).collect()}
    assert held() == {"a", "b", "c"}
    time.sleep(1.1)
    (root / "a.zz").write_text(f"// {M}domain changed\n")
    (root / "b.zz").unlink()
    (root / "e.zz").write_text(f"// {M}domain e\n")

    # a job that stops after its buckets were overwritten and before the others went
    whole = watch.delete
    monkeypatch.setattr(watch, "delete", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        watch.refresh(spark, str(root), target, **own)
    monkeypatch.setattr(watch, "delete", whole)
    watch.watch(spark, str(root), target, log, **own).awaitTermination(60)
    assert held() == {"changed", "c", "e"}


def test_a_failed_task_leaves_the_tree(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "f0.py").write_text("old\n")
    rows = spark.range(8).repartition(4).select(F.concat(F.lit("f"), "id", F.lit(".py")).alias("path"), F.concat(F.lit("new "), "id").alias("content"))
    failing = rows.withColumn("content", F.when(F.col("path") == "f7.py", F.raise_error(F.lit("lost task"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost task"):
        writers.put(failing, str(root))
    assert {p.name: p.read_text() for p in root.iterdir()} == {"f0.py": "old\n"}
    writers.put(rows, str(root), "20240101")
    assert {p.name: p.read_text() for p in root.iterdir()} == {f"f{i}.py": f"new {i}" for i in range(8)} | {"f0.py.20240101.bak": "old\n"}
    with pytest.raises(Exception, match="is not below"):
        writers.put(spark.createDataFrame([("../x.py", "")], "path string, content string"), str(root))
