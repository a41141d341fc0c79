"""The tree source: what is listed, links, filters, and agreement with the plain scan."""

import os

from pyspark.sql import functions as F

from srcatlas.sources import files, tree


def _tree(root):
    for name in ("a.py", "src/b.py", "src/deep/er/c.ts", "src/deep/d.txt", "node_modules/x/e.ts", "src/node_modules/f.py", "docs/g.py", "src/.h.py"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"line one\r\n" + name.encode())
    return str(root)


def test_excluded_folders_are_not_listed(spark, tmp_path):
    root = _tree(tmp_path / "t")
    told = []
    choice = tree.Choice(root, ["src/**/*.py"], ["**/node_modules/**"])
    assert sorted(rel for rel, _ in tree.walk(choice, told=lambda at, *_: told.append(at))) == ["src/.h.py", "src/b.py"]
    assert sorted(told) == ["", "src", "src/deep", "src/deep/er"]
    for splits in ("1", "2", "4", "64"):
        listed = tree.read(spark, root, (), ("**/node_modules/**",), table="folders", splits=splits).collect()
        assert sorted(r["path"] for r in listed) == ["", "docs", "src", "src/deep", "src/deep/er"]
    # an exclude glob that ends in a name passes over no folder
    assert sorted(rel for rel, _ in tree.walk(tree.Choice(root, [], ["src/*.py"]))) == ["a.py", "docs/g.py", "node_modules/x/e.ts", "src/deep/d.txt", "src/deep/er/c.ts"]


def test_equal_to_the_plain_scan(spark, tmp_path):
    root = _tree(tmp_path / "t")
    for include, exclude in ((("**/*.py", "**/*.ts"), ("**/node_modules/**",)), ((), ()), (("src/*",), ("*.txt",))):
        plain = [tuple(r) for r in files.scan(spark, root, include, exclude).select("path", "length", "language", "content").collect()]
        ours = [tuple(r) for r in tree.scan(spark, root, include, exclude).select("path", "length", "language", "content").collect()]
        # Spark's listing leaves out names that begin with a dot or an underscore
        assert sorted(map(str, plain)) == sorted(str(r) for r in ours if "/." not in r[0])
    assert {r["path"] for r in tree.scan(spark, root, ("src/*.py",), ("**/node_modules/**",)).collect()} == {"src/b.py", "src/.h.py"}
    assert tree.scan(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "empty").mkdir()
    assert tree.scan(spark, str(tmp_path / "empty")).count() == 0


def test_pushed_filters(spark, tmp_path):
    root = _tree(tmp_path / "t")
    rows = tree.read(spark, root)
    assert [r["path"] for r in rows.where("path = 'src/b.py'").collect()] == ["src/b.py"]
    assert {r["path"] for r in rows.where("path in ('src/b.py', 'docs/g.py', 'no')").collect()} == {"src/b.py", "docs/g.py"}
    assert {r["path"] for r in rows.where(F.col("path").startswith("src/deep") & (F.col("length") <= 24)).collect()} == {"src/deep/d.txt"}
    told = []
    choice = tree.Choice(root, pushed=[[("src/deep", False)]])
    assert sorted(rel for rel, _ in tree.walk(choice, told=lambda at, *_: told.append(at))) == ["src/deep/d.txt", "src/deep/er/c.ts"]
    assert sorted(told) == ["", "src", "src/deep", "src/deep/er"]


def test_links(spark, tmp_path):
    root = _tree(tmp_path / "t")
    os.symlink(root, f"{root}/src/up")  # leads back
    os.symlink(f"{root}/docs", f"{root}/src/linked")
    os.symlink(f"{root}/a.py", f"{root}/one.py")
    os.symlink(f"{root}/gone", f"{root}/broken.py")
    plain = {r["path"] for r in tree.scan(spark, root).collect()}
    assert not plain & {"one.py", "broken.py", "src/linked/g.py"}
    found = {r["path"][len(root) + 1 :] for r in tree.to_annotate(spark, root, ("**/*.py",), ("**/node_modules/**",)).collect()}
    assert found == {"a.py", "one.py", "src/b.py", "src/.h.py", "docs/g.py", "src/linked/g.py"}
    assert {r["path"][len(root) + 1 :] for r in tree.to_annotate(spark, root, ("**/*.py",), (), "*/docs/*").collect()} == {"docs/g.py"}
    assert tree.to_annotate(spark, root, ()).count() == 0


def test_a_large_folder_is_dealt_out_in_shares(tmp_path):
    (tmp_path / "deep").mkdir()
    wanted = {f"f{i}.py" for i in range(25)} | {"deep/g.py"}
    for name in wanted:
        (tmp_path / name).write_text("x")
    choice = tree.Choice(str(tmp_path))
    parts = tree.dealt(choice, 256, 10)
    read = [[rel for rel, _ in tree.walk(choice, p.rel, p.above, p.deep, share=p.share)] for p in parts]
    assert sorted(rel for part in read for rel in part) == sorted(wanted)
    assert len(parts) == 4 and max(map(len, read)) < 25
