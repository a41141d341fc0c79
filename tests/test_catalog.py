import json

import pytest

from srcatlas import cli, config
from srcatlas.catalog import Catalog, index
from srcatlas.operators import contexts, graph
from srcatlas.schema import MARKER as M

TREE = {
    "src/auth/login.ts": f'// {M}module "Login"\n// {M}domain auth\n// {M}lock frozen\nimport {{ hash }} from "../util/hash";\n\n/**\n * Logs a user in.\n */\nexport function login() {{\n  hash();\n}}\n',
    "src/util/hash.ts": f'// {M}domain util\n// {M}hack expires=2020-01-01 ticket=T-1 "old"\nexport function hash() {{ return 1; }}\n',
    "src/util/tool.py": f'# {M}domain util\n# {M}source heuristic\n# {M}source-confidence 0.4\ndef run():\n    """Runs it."""\n    return helper()\n',
    "node_modules/x.ts": "export function no() {}\n",
    "notes.md": "x",
}


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, body in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    where = str(tmp_path_factory.mktemp("tables") / "catalog")
    index(spark, str(root), config.Config(domains={"security": ["**/auth/**"]})).save(where)
    return where, Catalog.load(spark, where)


def test_tables(held):
    _, tables = held
    files = {r["path"]: r for r in tables.files.collect()}
    assert set(files) == {"src/auth/login.ts", "src/util/hash.ts", "src/util/tool.py"}
    login = files["src/auth/login.ts"]
    assert (login["module"], login["language"], login["lines"], login["domains"]) == ("Login", "typescript", 11, ["auth", "security"])
    assert files["src/util/hash.ts"]["imported_by"] == ["src/auth/login.ts"]
    symbols = {r["name"]: r for r in tables.symbols.collect()}
    assert symbols["login"]["summary"] == "Logs a user in." and symbols["run"]["summary"] == "Runs it."
    assert ("login", "hash") in {(r["caller"], r["callee"]) for r in tables.calls.collect()}
    assert [(r["path"], r["level"]) for r in tables.constraints.collect()] == [("src/auth/login.ts", "frozen")]
    assert str(tables.hacks.first()["expires"]) == "2020-01-01"
    found = {(r["path"], r["key"]): r for r in tables.provenance.collect()}
    assert found["src/util/tool.py", f"{M}domain"]["needs_review"]


def test_contexts(held):
    _, tables = held
    reverse = tables.files.select("path", "imported_by")
    rows = {r["path"]: r for r in contexts.modify(tables.files, reverse, tables.constraints).collect()}
    assert rows["src/util/hash.ts"]["importer_count"] == 1 and rows["src/auth/login.ts"]["level"] == "frozen"
    whole = contexts.explore(tables.files, tables.symbols, graph.key_files(reverse)).first()
    assert whole["files"] == 3 and whole["primary_language"] == "typescript" and whole["key_files"][0] == "src/util/hash.ts"
    made = {r["folder"]: r for r in contexts.create(tables.files, tables.conventions).collect()}
    assert made["src/util"]["similar"] == ["src/util/hash.ts", "src/util/tool.py"]
    debugged = {r["path"]: r for r in contexts.debug(tables.files, tables.symbols, graph.hotpaths(tables.calls)).collect()}
    assert debugged["src/util/hash.ts"]["hotpaths"] == ["hash"]


@pytest.mark.parametrize(
    ("arguments", "expected"),
    [
        (["query", "symbol", "hash"], '"callers":["login"]'), (["query", "file", "./src/util/../util/tool.py"], '"name":"run"'), (["query", "callers", "hash"], '{"caller":"login"}'),
        (["query", "domain", "util"], "src/util/hash.ts"), (["query", "stats"], '"files":3'), (["context", "modify", "src/util/hash.ts"], '"importer_count":1'), (["check"], "frozen"),
        (["check", "src/auth/login.ts"], "frozen"), (["review", "--confidence", "<0.5"], "tool.py"), (["map"], '"folder":"src/util"'), (["vars"], "SYM_LOGIN"),
        (["expand", "see $SYM_LOGIN", "--mode", "summary"], "see Logs a user in."), (["chain", "SYM_LOGIN"], "SYM_HASH"), (["query", "search", "HAS"], '"name":"hash"'),
    ],
)
def test_commands(held, capsys, spark, arguments, expected):
    assert cli.main(["--catalog", held[0], *arguments]) == 0
    assert expected in capsys.readouterr().out


def test_bridge_and_validate(held, spark, capsys, tmp_path):
    assert cli.main(["--catalog", held[0], "bridge"]) == 0 and '"merged_count"' in capsys.readouterr().out
    (tmp_path / "a.sync.json").write_text('{"version": "1.0.0", "tools": ["vim"]}')
    assert cli.main(["validate", str(tmp_path)]) == 1 and "unknown tool" in capsys.readouterr().out
    (tmp_path / "a.sync.json").write_text('{"version": "1.0.0", "tools": ["aider"]}')
    assert cli.main(["validate", str(tmp_path)]) == 0


def test_migrate(spark, capsys, tmp_path):
    (tmp_path / "a.ts").write_text(f"// {M}lock frozen\nx\n")
    assert cli.main(["migrate", str(tmp_path), "--diff"]) == 0
    assert f"-// {M}lock frozen\n+// {M}lock frozen - " in capsys.readouterr().out
    assert cli.main(["migrate", str(tmp_path), "--apply", "20240101"]) == 0
    assert (tmp_path / "a.ts").read_text().startswith(f"// {M}lock frozen - ") and (tmp_path / "a.ts.20240101.bak").read_text() == f"// {M}lock frozen\nx\n"


def test_gate(held, spark):
    assert cli.main(["--catalog", held[0], "gate", "--least", "1"]) == 0
    assert cli.main(["--catalog", held[0], "gate", "--least", "101"]) == 1


def test_problems(spark, tmp_path):
    (tmp_path / "bad.py").write_text("def (:\n")
    (tmp_path / "big.ts").write_text("x" * 2000)
    (tmp_path / "good.ts").write_text("export function f() {}\n")
    made = index(spark, str(tmp_path), config.Config(max_file_bytes=1000, bridge=False))
    found = {r["path"]: r["problem"] for r in made.problems.collect()}
    assert set(found) == {"bad.py", "big.ts"} and found["bad.py"].startswith("SyntaxError") and "2000 bytes" in found["big.ts"]
    assert {r["path"] for r in made.files.collect()} == {"bad.py", "good.ts"}


def test_configuration(tmp_path):
    path = str(tmp_path / "c.json")
    assert config.load(path).include == config.Config().include
    (tmp_path / "c.json").write_text(json.dumps({"include": ["**/*.x"], "limits": {"max_file_size_mb": 1}, "other": 5}))
    made = config.load(path)
    assert made.include == ["**/*.x"] and made.max_file_bytes == 1 << 20
    made.max_files = 7
    config.save(made, path)
    stored = json.loads((tmp_path / "c.json").read_text())
    assert stored["other"] == 5 and stored["limits"]["max_files"] == 7


def test_bridge_at_index_time(spark, tmp_path):
    (tmp_path / "a.ts").write_text(
        f'// {M}domain d\n// {M}source converted\n\n/**\n * Native words.\n * @param x the x\n * {M}fn "Noted words" kept - Keep it\n */\nexport function both(x) {{}}\n\n'
        f"/**\n * Only native.\n */\nexport function told() {{}}\n\nexport function bare() {{}}\n"
    )
    (tmp_path / "__init__.py").write_text("def hidden():\n    pass\n")
    for precedence, summary in (("acp-first", "Native words."), ("native-first", "Native words."), ("merge", "Native words. Noted words")):
        made = index(spark, str(tmp_path), config.Config(precedence=precedence))
        symbols = {r["name"]: (r["summary"], r["purpose"], r["bridge"]) for r in made.symbols.collect()}
        assert symbols["both"] == (summary, "Keep it", "merged")
        assert symbols["told"] == ("Only native.", None, "converted") and symbols["bare"] == (None, None, None) and "hidden" in symbols
        file = made.files.where("path = 'a.ts'").first()
        assert (file["explicit_count"], file["converted_count"], file["merged_count"]) == (1, 1, 1)
    plain = index(spark, str(tmp_path), config.Config(bridge=False))
    assert "merged_count" not in plain.files.columns
