import json
import os
import subprocess
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from srcatlas import parsers
from srcatlas.operators import attempts, bridge, constraints, conventions, graph, lookups, primer, rewrite, suggestions, validation, variables, writers
from srcatlas.schema import MARKER as M
from srcatlas.sources import documents, files, git
from srcatlas.streaming import watch


# Selection ------------------------------------------------------------------------------------------------------------------------------------


def section(i, tokens, value, **more):
    return primer.Section(id=f"s{i}", tokens=tokens, value=value, density=value / tokens if tokens else 0.0, **more)


@given(
    st.lists(st.tuples(st.integers(0, 60), st.integers(0, 300), st.booleans(), st.booleans(), st.integers(0, 100), st.lists(st.integers(0, 9), max_size=2), st.lists(st.integers(0, 9), max_size=2)), max_size=10),
    st.integers(0, 200),
)
def test_selection_keeps_its_rules(rows, budget):
    listed = [section(i, t, v, required=r, wanted=w, safety=s, depends=[f"s{d}" for d in dep], conflicts=[f"s{c}" for c in con]) for i, (t, v, r, w, s, dep, con) in enumerate(rows)]
    picked = primer.select(listed, budget)
    assert sum(s.tokens for s, _ in picked) <= budget
    ids = {s.id for s, _ in picked}
    assert len(ids) == len(picked)
    assert all(set(s.depends) <= ids for s, phase in picked if phase in ("safety", "value"))
    assert [s.priority for s, _ in picked] == sorted(s.priority for s, _ in picked)


def test_selection_phases():
    rows = [section(1, 50, 10, required=True, conflicts=["s2"]), section(2, 10, 999), section(3, 30, 5, wanted=True), section(4, 20, 50, safety=90), section(5, 25, 60, safety=95), section(6, 10, 1), section(7, 5, 9, depends=["s9"])]
    assert [(s.id, p) for s, p in primer.select(rows, 120)] == [("s1", "required"), ("s3", "conditional"), ("s5", "safety"), ("s6", "value")]


def test_templates():
    assert primer.render("a {{x}}\n{{#if y}}has {{y}}{{/if}}\nend", {"x": "1", "y": ""}) == "a 1\nend"
    assert primer.render("{{#if y}}has {{y}}{{/if}}", {"y": "2"}) == "has 2"


def test_capabilities(spark):
    frame = spark.createDataFrame([(None, None), (["a"], None), (["b"], None), (["a", "b"], ["a"]), (None, ["a", "c"])], "any array<string>, all array<string>")
    assert [r[0] for r in frame.select(primer.capable(F.col("any"), F.col("all"), ["a"])).collect()] == [True, True, False, True, False]


# Variables ------------------------------------------------------------------------------------------------------------------------------------

TABLE = {
    "AA": {"value": "x $BB y", "type": "symbol", "description": "an A"}, "BB": {"value": "<$CC>", "type": "file", "description": None},
    "CC": {"value": "loop $AA", "type": "domain", "description": "c"}, "KK": {"value": "k:v|q:w", "type": "symbol", "description": None},
}


@pytest.mark.parametrize(
    ("mode", "text", "expected"),
    [
        ("summary", "see $AA, $BB and $NO", "see an A, BB and $NO"), ("inline", "$AA", "x <loop [CYCLE:$AA]> y"), ("none", "$AA", "$AA"), ("annotated", "$KK", "**$KK** → K: v | Q: w"),
        ("summary", "$AA.value $AA.type $BB.summary.", "x $BB y symbol ."), ("interactive", "$CC", '<var name="CC" description="c">c</var>'),
    ],
)
def test_expansion(mode, text, expected):
    if mode == "summary" and "$NO" in text:
        assert variables.expander(TABLE, mode)(text) == (expected, ["BB", "AA"], ["NO"])
    else:
        assert variables.expander(TABLE, mode)(text)[0] == expected


def test_joined_expansion_agrees_with_recursion(spark):
    rows = [("A1", "x $B1 y $B1"), ("B1", "<$C1>$D1"), ("C1", "loop $A1"), ("D1", "plain"), ("E1", "$NOPE $D1"), ("F1", "")]
    frame = spark.createDataFrame(rows, "name string, value string")
    got = {r["name"]: r["expanded"] for r in variables.expand_values(frame).collect()}
    table = {n: {"value": v, "type": "symbol", "description": None} for n, v in rows}
    expand = variables.expander(table, "inline")
    assert got == {n: expand(f"${n}")[0] for n, _ in rows}


def test_chains():
    diamond = {"a": ["b", "c"], "b": ["d"], "c": ["d"], "d": []}
    assert variables.chain(diamond, "a") == (["a", "b", "d", "c"], False)
    assert variables.chain(diamond, "a", by_path=False) == (["a", "b", "d", "c"], True)
    assert variables.chain({"a": ["b"], "b": ["a"]}, "a") == (["a", "b"], True)


def test_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")], "src string, dst string")
    long = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 20}") for i in range(20)], "src string, dst string")
    assert {r["length"] for r in graph.cycles(long).collect()} == {20}
    assert {(r["node"], r["length"]) for r in graph.cycles(edges).collect()} == {("a", 3), ("b", 3), ("c", 3), ("e", 1)}


# Imports --------------------------------------------------------------------------------------------------------------------------------------


def test_import_candidates(spark):
    known = spark.createDataFrame([("src/a.ts",), ("src/lib/index.js",), ("src/x.py",), ("./top.go",)], "path string")
    specs = [("src/m.ts", "./a"), ("src/m.ts", "./lib"), ("src/lib/q.ts", "../x"), ("m.ts", "./top"), ("src/m.ts", "react"), ("src/m.ts", "/src/a.ts"), ("src/m.ts", "./none")]
    found = graph.resolve_imports(spark.createDataFrame(specs, "importer string, spec string"), known)
    assert {(r["spec"], r["imported"]) for r in found.collect()} == {("./a", "src/a.ts"), ("./lib", "src/lib/index.js"), ("../x", "src/x.py"), ("./top", "./top.go"), ("/src/a.ts", "src/a.ts")}


def test_exploring_counts_files_of_unknown_languages(spark):
    from srcatlas.operators import contexts

    rows = [("a", None, 1, ["d", "d"]), ("b", None, 2, []), ("c", None, 3, ["e"]), ("x", "go", 4, ["d"]), ("y", "python", 5, None)]
    files = spark.createDataFrame(rows, "path string, language string, lines long, domains array<string>")
    symbols, keys = spark.createDataFrame([("s",)], "name string"), spark.createDataFrame([("a",)], "path string")
    whole = contexts.explore(files, symbols, keys).first().asDict(recursive=True)
    assert whole == {"files": 5, "lines": 15, "symbols": 1, "primary_language": "go", "domains": [{"name": "d", "files": 2}, {"name": "e", "files": 1}], "key_files": ["a"]}
    none = contexts.explore(files.where("false"), symbols.where("false"), keys.where("false")).first()
    assert (none["files"], none["lines"], none["symbols"], none["primary_language"], none["domains"], none["key_files"]) == (0, None, 0, None, [], [])


# Suggestions and rewriting --------------------------------------------------------------------------------------------------------------------


def test_levels_grow():
    levels = [set(suggestions.LEVELS[x]) for x in ("minimal", "standard", "full")]
    assert levels[0] < levels[1] < levels[2]


def test_priority_is_idempotent(spark):
    rows = [("t", 1, "lock", "a", "heuristic", 0.9, 0), ("t", 1, "lock", "b", "explicit", 0.1, 5), ("t", 1, "domain", "c", "converted", 1.0, 2), ("t", 1, "domain", "d", "converted", 1.0, 1)]
    frame = spark.createDataFrame(rows, "target string, line long, kind string, value string, source string, confidence double, ord long")
    once = suggestions.priority(frame)
    assert {(r["kind"], r["value"]) for r in once.collect()} == {("lock", "b"), ("domain", "d")}
    assert sorted(map(tuple, suggestions.priority(once).collect())) == sorted(map(tuple, once.collect()))


def test_rewriting():
    source = "import x\n\n/**\n * Doc.\n */\n  export function f() {}\n"
    change = {"line": 6, "is_file": False, "doc_start": 3, "doc_end": 5, "texts": [f'{M}summary "s"', f"{M}lock normal"]}
    out = rewrite.apply(source, "typescript", [change])
    assert out.split("\n")[2:6] == ["/**", f'   * {M}summary "s"', f"   * {M}lock normal", " * Doc."]
    again = rewrite.apply(out, "typescript", [{**change, "line": 8, "doc_end": 7}])
    assert again == out.rstrip("\n")
    assert rewrite.apply("def f():\n    pass", "python", [{"line": 1, "is_file": False, "texts": ["t"], "doc_start": 2}]) == "# t\ndef f():\n    pass"
    assert rewrite.apply("fn f() {}", "rust", [{"line": 1, "is_file": True, "texts": ["t"]}]).startswith("//! t\n")
    assert "+# t" in rewrite.diff("a", "# t\na", "p")


def test_marker_sections():
    first = rewrite.between_markers("head\n", "one", "<!-- b -->", "<!-- e -->")
    assert first == "head\n\n<!-- b -->\none\n<!-- e -->"
    assert rewrite.between_markers(first + "\ntail", "two", "<!-- b -->", "<!-- e -->") == "head\n\n\n<!-- b -->\ntwo\n<!-- e -->\n\ntail"
    assert first.startswith("head\n")


# Bridge ---------------------------------------------------------------------------------------------------------------------------------------


def test_merged_entries_in_order(spark):
    native = spark.createDataFrame([("k", 0, "b", "T", "t"), ("k", 1, "a", None, None)], "key string, ord long, name string, type string, text string")
    noted = spark.createDataFrame([("k", 0, "z", "dz"), ("k", 1, "a", "da"), ("k", 2, "a", "other")], "key string, ord long, name string, directive string")
    made = bridge.in_order(bridge.merge_entries(native, noted)).first()["entries"]
    assert [(e["name"], e["directive"], e["source"]) for e in made] == [("b", None, "converted"), ("a", "da", "merged"), ("z", "dz", "explicit")]


def test_formats(spark):
    rows = [("python", "x\n\nParameters\n----------\n"), ("python", ":param x: y"), ("python", "Args:\n  x"), ("python", "no"), ("rust", "/// a"), ("typescript", "@param x"), ("typescript", "none"), ("go", ""), ("ruby", "")]
    frame = spark.createDataFrame(rows, "language string, content string")
    found = [r[0] for r in frame.select(bridge.detect(F.col("content"), F.col("language"))).collect()]
    assert found == ["docstring:numpy", "docstring:sphinx", "docstring:google", None, "rustdoc", "jsdoc", None, "godoc", None]
    assert [r[0] for r in frame.select(bridge.detect(F.col("content"), F.col("language"), disabled=("go",))).collect()][7] is None


# Constraints, lookups, validation, attempts ---------------------------------------------------------------------------------------------------


def test_permissions(spark):
    rows = [("frozen", "edit", ["edit"]), ("restricted", "edit", ["edit"]), ("restricted", "drop", ["edit"]), ("restricted", "edit", None), ("approval-required", "x", None), ("normal", "x", None)]
    frame = spark.createDataFrame(rows, "level string, op string, allowed array<string>")
    found = [r[0] for r in frame.select(constraints.permission(F.col("level"), F.col("op"), F.col("allowed"))).collect()]
    assert found == ["denied", "approval", "denied", "approval", "approval", "allowed"]


def test_review(spark):
    frame = spark.createDataFrame([("t1", "k", "heuristic", 0.4, True, False), ("t2", "k", "heuristic", None, True, False), ("t3", "k", "refined", 0.1, True, False), ("t4", "k", "heuristic", 0.1, True, True)], "target string, key string, source string, confidence double, needs_review boolean, reviewed boolean")
    assert [r["target"] for r in lookups.review_queue(frame, "heuristic", "<0.5").collect()] == ["t1", "t2"]
    marked = lookups.mark_reviewed(frame, F.col("target") == "t1")
    assert [r["target"] for r in lookups.review_queue(marked).collect()] == ["t3", "t2"]


def test_validation(spark):
    rows = [("a", ["a"], ["b"], 1), ("b", [], ["a"], 1), ("c", [], ["nobody"], 0)]
    frame = spark.createDataFrame(rows, "id string, conflicts array<string>, depends array<string>, formats long")
    assert {(r["key"], r["message"]) for r in validation.violations(frame, "sections", "id").collect()} == {("a", "conflicts with itself"), ("c", "no formats")}
    assert [tuple(r) for r in validation.unknown_dependencies(frame).collect()] == [("c", "nobody")]
    assert {r["node"] for r in validation.dependency_cycles(frame).collect()} == {"a", "b"}


def test_attempts(spark):
    events = spark.createDataFrame([("a", "active", 1, 1), ("a", "failed", 2, 2), ("b", "active", 1, 3), ("b", "verified", 5, 4), ("c", "active", 9, 5)], "id string, status string, ts long, seq long")
    assert {(r["id"], r["status"]) for r in attempts.state(events).collect()} == {("a", "failed"), ("c", "active")}
    assert {(r["id"], r["status"], r["started_at"], r["ended_at"]) for r in attempts.history(events).collect()} == {("a", "failed", 1, 2), ("b", "verified", 1, 5)}
    assert attempts.latest_active(events).first()["id"] == "c"


def test_naming(spark):
    names = [f"src/api/{n}.routes.ts" for n in "abc"] + ["src/api/x.ts"] + ["lib/a.go", "lib/b.rs", "lib/c.py"] + ["few/a.ts"]
    found = conventions.naming(spark.createDataFrame([(n,) for n in names], "path string")).collect()
    assert [(r["folder"], r["pattern"], r["confidence"], r["avoid"]) for r in found] == [("src/api", "*.routes.ts", 0.75, ["*.route.ts"])]


# Parsers --------------------------------------------------------------------------------------------------------------------------------------

SOURCES = {
    "typescript": ("import { a } from './b';\n/** Doc. */\nexport class K {\n  private x: number;\n  run(): void { a(); }\n}\nexport const f = () => { g(); };\ninterface I { y: string }\nenum E { A, B }\ntype T = string;\n",
                   {("class", "K"), ("property", "K.x"), ("method", "K.run"), ("function", "f"), ("interface", "I"), ("enum", "E"), ("type_alias", "T")}),
    "rust": ("use std::fmt;\n/// Doc.\npub struct S { pub a: u32 }\nimpl S {\n    pub fn new() -> Self { go() }\n    fn get(&self) -> u32 { self.a }\n}\npub enum E { A, B(u8) }\npub(crate) fn go() {}\nconst X: u8 = 1;\n",
             {("struct", "S"), ("field", "S.a"), ("impl", "S"), ("function", "S.new"), ("method", "S.get"), ("enum", "E"), ("enum_variant", "E.A"), ("enum_variant", "E.B"), ("function", "go"), ("constant", "X")}),
    "go": ("package p\nimport \"fmt\"\n// Doc.\ntype S struct {\n\tA int\n}\nfunc (s *S) Get() int { return s.A }\nfunc do() { fmt.Println(1) }\n",
           {("struct", "S"), ("field", "S.A"), ("method", "Get"), ("function", "do")}),
    "java": ("import java.util.List;\n/** Doc. */\npublic class C {\n  private int x;\n  public C() { go(); }\n  void go() {}\n}\ninterface I {\n  int get();\n}\n",
             {("class", "C"), ("field", "C.x"), ("method", "C.C"), ("method", "C.go"), ("interface", "I"), ("method", "I.get")}),
    "python": ("import os\nclass C:\n    'Doc.'\n    def a(self):\n        return os.getcwd()\n\nasync def _b(x=1):\n    C()\n", {("class", "C"), ("method", "C.a"), ("function", "_b")}),
}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_symbols(language):
    content, expected = SOURCES[language]
    rows = parsers.extract(content, language)
    assert {(r["kind"], r["qualified_name"]) for r in rows if r["what"] == "symbol"} == expected
    assert any("Doc." in (r["doc"] or "") for r in rows if r["what"] == "symbol")
    assert sum(r["what"] == "import" for r in rows) == 1
    assert any(r["what"] == "call" for r in rows)


@given(st.text(alphabet="{}()\"'`/*;\n ab=fnclas", max_size=80), st.sampled_from(sorted(SOURCES)))
def test_broken_sources_do_not_fail(content, language):
    parsers.extract(content, language)


# Sources and streams --------------------------------------------------------------------------------------------------------------------------


def test_scan(spark, tmp_path):
    for name, body in {"a.ts": "x", "lib/b.py": "y\n", "node_modules/c.ts": "z", "d.txt": "t", "big.go": "g" * 200}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    found = files.scan(spark, str(tmp_path), max_bytes=100).collect()
    assert {(r["path"], r["language"], r["content"]) for r in found} == {("a.ts", "typescript", "x"), ("lib/b.py", "python", "y\n")}
    assert "content" not in files.scan(spark, str(tmp_path), content=False).columns


def test_git(spark, tmp_path):
    repo = str(tmp_path)
    env = os.environ | {"GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "Ann", "GIT_COMMITTER_EMAIL": "a@x", "GIT_CONFIG_GLOBAL": "/dev/null"}
    call = lambda *a: subprocess.run(["git", "-C", repo, *a], check=True, env=env, capture_output=True)
    call("init", "-q", "-b", "main")
    for text in ("one\n", "one\ntwo\n"):
        (tmp_path / "f.py").write_text(text)
        call("add", "-A")
        call("commit", "-qm", f"say {text.split()[-1]}")
    (tmp_path / "new.py").write_text("")
    log = git.read(spark, repo).collect()
    assert sorted((r["path"], r["author"], r["added"], r["removed"], r["message"]) for r in log) == [("f.py", "Ann", 1, 0, "say one"), ("f.py", "Ann", 1, 0, "say two")]
    blame = git.read(spark, repo, "blame").orderBy("line_no").collect()
    assert [(r["line_no"], r["summary"]) for r in blame] == [(1, "say one"), (2, "say two")]
    assert [tuple(r) for r in git.read(spark, repo, "status").collect()] == [("new.py", "untracked")]
    assert git.head(repo)["branch"] == "main" and git.head(repo)["dirty"] and git.head(repo)["remote"] is None


def test_git_paths_of_any_letters(spark, tmp_path):
    repo = str(tmp_path)
    env = os.environ | {"GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "Ann", "GIT_COMMITTER_EMAIL": "a@x", "GIT_CONFIG_GLOBAL": "/dev/null"}
    call = lambda *a: subprocess.run(["git", "-C", repo, *a], check=True, env=env, capture_output=True)
    call("init", "-q", "-b", "main")
    names = ["naïve.py", "two words.py", 'quo"te.py', "日本.py"]
    for name in names:
        (tmp_path / name).write_text(f"x = 1  # {name}\ny = 2\nz = 3\n")
    call("add", "-A")
    call("commit", "-qm", "first")
    call("commit", "-qm", "nothing", "--allow-empty")
    assert sorted((r["path"], r["added"]) for r in git.read(spark, repo).collect()) == sorted((n, 3) for n in names)
    blamed = git.read(spark, repo, "blame", filesPerTask="2")
    assert blamed.rdd.getNumPartitions() == 2
    assert sorted({r["path"] for r in blamed.collect()}) == sorted(names) and blamed.count() == 12
    call("mv", "naïve.py", "new naïve.py")
    (tmp_path / "日本.py").write_text("x = 2\n")
    assert sorted(tuple(r) for r in git.read(spark, repo, "status").collect()) == [("new naïve.py", "staged"), ("日本.py", "modified")]
    assert git.is_tracked(repo, "new naïve.py") and not git.is_tracked(repo, "naïve.py")


def test_watch_forgets_what_went(spark, tmp_path):
    root, target, log = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "log")
    root.mkdir()
    for name in ("a", "b", "c"):
        (root / f"{name}.ts").write_text(f"// {M}domain {name}\n")
    watch.watch(spark, str(root), target, log).awaitTermination(60)
    time.sleep(1.1)
    (root / "a.ts").write_text("no annotation any more\n")
    (root / "b.ts").unlink()
    watch.watch(spark, str(root), target, log).awaitTermination(60)
    spark.catalog.refreshByPath(target)
    assert {r["value"] for r in spark.read.parquet(target).collect()} == {"c"}


def test_state_rewrites_only_its_buckets(spark, tmp_path):
    target = str(tmp_path / "state")
    write = watch.upsert_state(target, ["id"], "seq")
    write(spark.createDataFrame([(f"a{i}", 1, "x") for i in range(40)], "id string, seq long, v string"), 0)
    before = {p: os.stat(p).st_ino for p in map(str, (tmp_path / "state").rglob("*.parquet"))}
    write(spark.createDataFrame([("a3", 2, "y"), ("a3", 1, "z"), ("new", 1, "n")], "id string, seq long, v string"), 1)
    spark.catalog.refreshByPath(target)
    found = {r["id"]: r["v"] for r in spark.read.parquet(target).collect()}
    assert found == {f"a{i}": "x" for i in range(40)} | {"a3": "y", "new": "n"}
    after = {p: os.stat(p).st_ino for p in map(str, (tmp_path / "state").rglob("*.parquet"))}
    assert len(before.keys() & after.keys()) >= len(before) - 2


def test_verbs(spark):
    names = ["isReady", "hasItems", "processOrder", "applyPatch", "focusField", "getUser", "mkdir", "initCache", "playSound", "fixBug", "runs", "canEdit"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(suggestions.summary(F.col("n"), F.lit("function")).alias("s")).collect()
    assert [r["s"] for r in rows] == [
        "Checks if ready", "Checks if has items", "Processorder function", "Applies patch", "Focuses field", "Gets user", "Creates directory", "Initializes cache", "Plays sound", "Fixes bug", "Runs function", "Checks if can edit",
    ]


def test_writers(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("old\n")
    (root / "same.py").write_text("same\n")
    rows = spark.createDataFrame([("a.py", "new é\n"), ("sub/b.py", "made\r\n"), ("same.py", "same\n"), ("none.py", None)], "path string, content string")
    done = {r["path"]: (r["written"], r["backup"]) for r in writers.write_files(rows, str(root), "20240101").collect()}
    assert done == {"a.py": (True, "a.py.20240101.bak"), "sub/b.py": (True, None), "same.py": (False, None)}
    assert (root / "a.py").read_text() == "new é\n" and (root / "a.py.20240101.bak").read_text() == "old\n"
    assert (root / "sub/b.py").read_bytes() == b"made\r\n" and not (root / "none.py").exists()
    again = writers.write_files(rows, str(root), "20240101").collect()
    assert not any(r["written"] for r in again) and (root / "a.py.20240101.bak").read_text() == "old\n"
    stored = spark.createDataFrame([("a.py", "old\n")], "path string, content string")
    assert writers.restore(stored, str(root)).first()["written"] and (root / "a.py").read_text() == "old\n"
    with pytest.raises(Exception, match="is not below"):
        writers.write_files(spark.createDataFrame([("../x.py", "")], "path string, content string"), str(root)).collect()


def test_rewritten_sources_in_place(spark, tmp_path):
    (tmp_path / "m.py").write_text("def f():\n    pass\n")
    code = files.scan(spark, str(tmp_path)).select("path", "language", "content")
    none = F.lit(None).cast("long")
    wanted = code.select("path", F.lit("f").alias("target"), F.lit(1).cast("long").alias("line"), F.lit(f'{M}summary "s"').alias("text"), F.lit(False).alias("is_file"), none.alias("doc_start"), none.alias("doc_end"), F.lit(0).alias("ord"))
    made = rewrite.preview(code, rewrite.plan(wanted))
    assert writers.write_files(made.withColumn("content", F.concat("content", F.lit("\n"))), str(tmp_path), "1").count() == 1
    assert (tmp_path / "m.py").read_text() == f'# {M}summary "s"\ndef f():\n    pass\n'
    assert (tmp_path / "m.py.1.bak").read_text() == "def f():\n    pass\n"


def test_attempts_document(spark, tmp_path):
    stored = {"attempts": {"x1": {"id": "x1", "status": "active", "for_issue": "7", "files": [{"path": "a", "original_hash": "h"}], "odd": 1}, "x2": {"id": "x2", "status": "failed"}}}
    (tmp_path / "a.json").write_text(json.dumps(stored, indent=1))
    found = documents.attempts(documents.read_document(spark, str(tmp_path / "a.json"))).orderBy("key").collect()
    assert [(r["id"], r["status"], r["for_issue"], len(r["files"] or [])) for r in found] == [("x1", "active", "7", 1), ("x2", "failed", None, 0)]


def test_json_and_other_merges():
    assert json.loads(rewrite.merged_json('{"a": 1, "b": {"x": 1}}', '{"b": {"y": 2}, "c": 3}')) == {"a": 1, "b": {"y": 2}, "c": 3}
    assert rewrite.merged_json("[1]", '{"a": 1}') == "[\n  1\n]"
    assert rewrite.merged("old", "new", "replace", "<", ">") == "new" and rewrite.merged("old\n\n", "new", "append", "<", ">") == "old\n\nnew"
    with pytest.raises(ValueError):
        rewrite.merged("", "", "odd", "<", ">")


def test_scan_of_odd_names(spark, tmp_path):
    root = tmp_path / "a+b é" / "src"
    (root / "src").mkdir(parents=True)
    for name in ("one two.py", "50%.py", "c+d.py", "src/é.py"):
        (root / name).write_text("x")
    (root / "big.py").write_text("y" * (11 << 20))
    assert sorted(r["path"] for r in files.scan(spark, str(root), content=False).collect()) == sorted(["one two.py", "50%.py", "c+d.py", "src/é.py", "big.py"])


def test_presets():
    assert [p[0] for p in primer.presets()] == ["safe", "efficient", "accurate", "balanced"]


def test_documents(spark, tmp_path):
    stored = {"files": {"a.ts": {"path": "a.ts", "language": "typescript", "lines": 3, "exports": ["x"], "unknown": 1}}, "symbols": {"x": {"name": "x", "lines": [1, 2], "exported": True}}}
    (tmp_path / "c.json").write_text(json.dumps(stored, indent=2))
    held = documents.read_document(spark, str(tmp_path / "c.json"))
    assert [(r["key"], r["language"], r["lines"], r["exports"]) for r in documents.files(held).collect()] == [("a.ts", "typescript", 3, ["x"])]
    made = spark.createDataFrame([("v1", "symbol", 'a"b', []), ("v2", "file", None, ["v1"])], "key string, type string, value string, refs array<string>")
    text = documents.document(made, "key", "variables").first()["json"]
    assert json.loads(text) == {"variables": {"v1": {"type": "symbol", "value": 'a"b', "key": "v1"}, "v2": {"type": "file", "refs": ["v1"], "key": "v2"}}}


def test_watch_updates_changed_files_only(spark, tmp_path):
    root, target, log = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "log")
    root.mkdir()
    (root / "a.ts").write_text(f"// {M}domain one\n")
    (root / "b.ts").write_text(f"// {M}domain two\n")
    watch.watch(spark, str(root), target, log).awaitTermination(60)
    read = lambda: {(os.path.basename(r["path"]), r["value"]) for r in spark.read.parquet(target).collect()}
    assert read() == {("a.ts", "one"), ("b.ts", "two")}
    time.sleep(1.1)
    (root / "c.ts").write_text(f"// {M}domain three\n// {M}layer x\n")
    watch.watch(spark, str(root), target, log).awaitTermination(60)
    spark.catalog.refreshByPath(target)
    assert read() == {("a.ts", "one"), ("b.ts", "two"), ("c.ts", "three"), ("c.ts", "x")}


def test_parsed_rows_of_wanted_kinds_and_long_files(spark):
    import time

    from srcatlas import parsers

    code = "".join(f"/** Does {i}. */\nexport function f{i}(x) {{\n  return g{i}(x);\n}}\n" for i in range(3000))
    files = spark.createDataFrame([("a.ts", "typescript", code), ("b.py", "python", "import os\ndef f(a, b):\n    os.path.join(a)\n"), ("c.py", "python", "def (")], "path string, language string, content string")
    calls = parsers.parse(files, "call")
    assert {r.what for r in calls.select("what").distinct().collect()} == {"call", "error"}
    whole = parsers.parse(files)
    for one, kind in ((parsers.calls, "call"), (parsers.symbols, "symbol"), (parsers.imports, "import")):
        assert sorted(map(str, one(parsers.parse(files, kind)).collect())) == sorted(map(str, one(whole).collect()))
    assert parsers.symbols(whole).where("path = 'b.py'").first().signature == "f(a, b)"
    begun = time.process_time()
    rows = parsers.extract(code, "typescript")
    assert len(rows) == 6000 and time.process_time() - begun < 3  # in proportion to the text


def test_sources_are_spread_over_short_tasks(spark, monkeypatch):
    from srcatlas.plans import derived

    monkeypatch.setattr(derived, "TASK_ROWS", 100, raising=False)
    assert derived.spread(spark.range(0, 20_000, 1, spark.sparkContext.defaultParallelism)).rdd.getNumPartitions() == 200


def test_texts_with_more_variables_than_may_be_sent(spark):
    from srcatlas.operators import variables

    rows = [("V1", "one $V2.value", "symbol", "first"), ("V2", "two $V3 $GONE", "file", None), ("V3", "three $V1", "file", "third"), ("V4", "k: v|l: w", "domain", "")]
    table = spark.createDataFrame(rows, "name string, value string, type string, description string")
    texts = spark.createDataFrame([(1, "a $V1 b $V2.type $NO $V1"), (1, "a $V1 b $V2.type $NO $V1"), (2, "plain"), (3, None), (None, "$V4 $V3.value"), (5, "")], "id long, text string")
    for mode in variables.MODES:
        few = sorted(map(str, variables.expand_texts(texts, table, mode).collect()))
        assert few == sorted(map(str, variables.expand_texts(texts, table, mode, most=2).collect()))
