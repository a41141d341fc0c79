import pytest

from srcatlas import cli
from srcatlas.operators import analysis, rewrite
from srcatlas.schema import MARKER as M

FILES = "path string, language string, content string"
TS = "/**\n * Tells.\n */\nexport function f() {}\n"


def gaps(spark, rows, level="standard"):
    found = analysis.analyze(spark.createDataFrame(rows, FILES), level)
    return {(r["path"], r["target"], r["line"]): r for r in found.gaps.collect()}, {r["path"]: r for r in found.coverage.collect()}


def test_equal_names_in_different_files_stay_apart(spark):
    noted = f'/**\n * {M}summary "x"\n * {M}lock frozen\n */\nexport function f() {{}}\n'
    found, coverage = gaps(spark, [("a.ts", "typescript", TS), ("b.ts", "typescript", noted)])
    assert found["a.ts", "f", 4]["missing"] == ["summary", "domain", "lock", "layer", "deprecated"]
    assert found["b.ts", "f", 5]["missing"] == ["domain", "layer", "deprecated"]
    assert (coverage["b.ts"]["existing"], coverage["b.ts"]["missing"], coverage["b.ts"]["coverage"]) == (2, 2, 50.0)


@pytest.mark.parametrize(("level", "kinds"), [("minimal", ["summary"]), ("full", ["summary", "domain", "lock", "layer", "deprecated", "stability", "ai-hint", "ref", "hack", "lock-reason"])])
def test_levels(spark, level, kinds):
    found, _ = gaps(spark, [("a.ts", "typescript", TS)], level)
    assert found["a.ts", "f", 4]["missing"] == kinds
    assert found["a.ts", "a.ts", 1]["missing"] == (["module", "summary"] if level == "minimal" else ["module", "summary", "domain"])


def test_who_needs_annotations(spark):
    java = "public class Open {\n  protected void kept() {}\n  private void own() {}\n  public void told() {}\n}\nclass Hidden {}\n"
    found, _ = gaps(spark, [("A.java", "java", java), ("a.py", "python", "class _C:\n    pass\ndef _f():\n    pass\n@dec\ndef g():\n    '''Says.'''\n")])
    assert {t for p, t, _ in found if p == "A.java"} == {"A.java", "Open", "Open.told", "Hidden"}
    assert {t for p, t, _ in found if p == "a.py"} == {"a.py", "_C", "g"}
    # a docstring has no block above its symbol: its height is taken
    assert (found["a.py", "g", 5]["insertion_line"], found["a.py", "g", 5]["doc_start"], found["a.py", "g", 5]["doc_end"]) == (5, 4, 4)


def test_far_annotations_belong_to_the_file(spark):
    far, near = f"// {M}domain d\n" + "\n" * 20 + "export class C {}\n", f"// {M}domain d\n" + "\n" * 19 + "export class C {}\n"
    found, _ = gaps(spark, [("far.ts", "typescript", far), ("near.ts", "typescript", near)])
    assert "domain" in found["far.ts", "C", 22]["missing"] and "domain" not in found["far.ts", "far.ts", 1]["missing"]
    assert "domain" not in found["near.ts", "C", 21]["missing"] and "domain" in found["near.ts", "near.ts", 1]["missing"]


def test_odd_files(spark):
    rows = [("bad.py", "python", "def (:\n"), ("x.txt", "unknown", f"{M}lock frozen\n"), ("n.go", "go", None), ("e.rs", "rust", ""), ("l.ts", None, "x")]
    found, coverage = gaps(spark, rows)
    assert set(found) == {("n.go", "n.go", 1), ("e.rs", "e.rs", 1)}
    assert coverage["bad.py"]["coverage"] == 100.0 and coverage["x.txt"]["existing"] == 1 and coverage["e.rs"]["coverage"] == 0.0
    nothing, none = gaps(spark, [])
    assert nothing == {} and none == {}
    assert analysis.total(analysis.analyze(spark.createDataFrame([], FILES)).coverage).first()["coverage"] == 100.0


def test_overloads_and_long_files(spark):
    many = "".join(f"export function f{i}() {{}}\n" for i in range(3000))
    twice = "class C {\n  public void a(int x) {}\n  public void a(String x) {}\n}\n"
    code = spark.createDataFrame([("m.ts", "typescript", many), ("T.java", "java", twice)], FILES)
    found = analysis.analyze(code).gaps
    assert found.where("path = 'm.ts'").count() == 3001 and found.where("target = 'C.a'").count() == 2
    changes = analysis.changes(analysis.suggest(found, code)).collect()
    assert [c["line"] for c in changes if c["target"] == "C.a"] == [2]
    assert len(changes) == len({(c["path"], c["target"]) for c in changes})


def test_sources_of_annotations(spark):
    code = spark.createDataFrame([("a.ts", "typescript", TS)], FILES)
    changes = analysis.changes(analysis.suggest(analysis.analyze(code).gaps, code, least=0.6), provenance=True, generation="g1")
    text = rewrite.contents(rewrite.script(code, changes)).first()["content"]
    assert f' * {M}summary "Tells."\n * {M}source converted\n * {M}source-reviewed false\n * {M}source-id "g1"\n * Tells.' in text
    assert f'{M}module "A"\n * {M}source heuristic\n * {M}source-confidence 0.70' in text and f"{M}lock" not in text


def test_command(spark, capsys, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.ts").write_text(TS)
    (tmp_path / "sub" / "b.py").write_text("def run():\n    pass")
    run = lambda *more: cli.main(["--config", str(tmp_path / "none.json"), "annotate", str(tmp_path), *more])
    assert run() == 0 and '"value":"Tells."' in capsys.readouterr().out
    assert run("--check", "1") == 1 and capsys.readouterr().out.strip() == "0.0"
    assert run("--diff", "--filter", "sub/*") == 0
    shown = capsys.readouterr().out
    assert f'+# {M}summary "Run function"' in shown and "a.ts" not in shown
    assert run("--apply", "s1") == 0
    assert (tmp_path / "a.ts").read_text().endswith(f'/**\n * {M}summary "Tells."\n * {M}lock normal\n * Tells.\n */\nexport function f() {{}}\n')
    assert (tmp_path / "a.ts.s1.bak").read_text() == TS and not (tmp_path / "sub" / "b.py").read_text().endswith("\n")
    assert run("--coverage") == 0 and '"path":"a.ts","existing":4' in capsys.readouterr().out
    assert run("--check", "1") == 0


def test_no_table_of_files_or_symbols_is_sent_through_the_driver(spark):
    files = spark.createDataFrame([("a.ts", "typescript", "/** Does. */\nexport function f() {\n}\n")], "path string, language string, content string")
    found = analysis.analyze(files)
    text_lines, parsed = analysis.annotations.lines(files), analysis.parsers.parse(files)
    for rows in (analysis.gaps(files, text_lines, parsed, found.existing), found.coverage, analysis.suggest(found.gaps, files)):
        assert "Broadcast" not in rows._jdf.queryExecution().sparkPlan().toString()


ODD = [
    ("a.ts", "typescript", TS), ("b.ts", "typescript", f'/**\n * {M}summary "x"\n */\n\n@A\n@B({{}})\nexport class K {{\n}}\nexport function f() {{}}\n'), ("bad.py", "python", "def (:\n"),
    ("n.go", "go", None), ("e.rs", "rust", ""), ("l.ts", None, f"{M}lock frozen"), ("r.rs", "rust", f"// {M}domain d\n#[x]\n/// Says.\npub struct S {{}}\r\n\r\npub fn g() {{}}\r\n"),
    ("p.py", "python", f"# {M}module m\n@dec\ndef g():\n    '''Says.'''\nclass C:\n    def run(self): pass\n"), ("t.ts", "typescript", "export function a() {} export function a() {}\n"),
    ("far.ts", "typescript", "/**\n" + " * far\n" * 90 + " */\n" + "@D\n" * 80 + "export class F {\n}\n// x\nexport function last() {}\n"),
]


@pytest.mark.parametrize("level", ["standard", "full"])
def test_rows_of_files_give_what_tables_of_lines_give(spark, level):
    files = spark.createDataFrame(ODD, FILES)
    parsed, text_lines = analysis.parsers.parse(files), analysis.annotations.lines(files)
    found = analysis.analyze(files, level)
    noted = analysis.existing(text_lines, analysis._symbols(parsed))
    told = lambda rows: sorted((repr(tuple(r)) for r in rows.collect()))
    assert told(found.existing.select(*noted.columns)) == told(noted)
    tabled = analysis.gaps(files, text_lines, parsed, noted, level)
    assert told(found.gaps.select(*tabled.columns)) == told(tabled) != []
    twice = [(r["target"], r["line"], r["kind"]) for r in analysis.suggest(found.gaps, files, level).where("path = 't.ts'").collect()]
    assert len(set(twice)) == len(twice) > 0


def test_files_are_analysed_where_they_lie(spark):
    files = spark.createDataFrame(ODD, FILES)
    found = analysis.analyze(files)
    for rows in (analysis.facts(files), found.existing, found.gaps, found.coverage, analysis.suggest(found.gaps, files)):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_texts_put_in_order_in_their_row(spark):
    code = spark.createDataFrame([r for r in ODD if r[2]], FILES)
    changes = analysis.changes(analysis.suggest(analysis.analyze(code).gaps, code))
    one, two = rewrite.contents(rewrite.script(code, changes)), rewrite.rewritten(code, changes)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) != []
