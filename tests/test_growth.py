"""Work that has to grow with the tables: tasks, shuffles, what is read again."""

import math

from srcatlas.plans import QUERIES, derived
from srcatlas.plans.code import _notes


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_files_lines_stay_in_the_task_that_makes_them(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(derived, "TASK_ROWS", 100)
    found = _notes(spark, sf_dir)
    wanted = max(spark.sparkContext.defaultParallelism, math.ceil(spark.read.parquet(f"{sf_dir}/orders.parquet").count() / 100))
    assert found.rdd.getNumPartitions() == wanted
    for df in (found, QUERIES["f06_files_in_layer"](spark, sf_dir)):
        assert planned(df).count("Exchange hashpartitioning") == 1, planned(df)


def test_notes_are_made_once(spark, sf_dir):
    for name in ("g16_debug_context", "g16_debug_symbol_context", "g23_project_state", "g16_modify_context"):
        plan = planned(QUERIES[name](spark, sf_dir))
        assert "posexplode" not in plan and "Bucketed: true" in plan, name


def test_an_exploration_makes_its_notes_once(spark, sf_dir):
    """Lines are split and sorted by path once, then read in buckets; only imports are dealt out anew."""
    plan = planned(QUERIES["g16_explore_context"](spark, sf_dir))
    assert "posexplode" not in plan and "Bucketed: true" in plan, plan


def test_an_exploration_reads_its_notes_four_times(spark, sf_dir):
    """For counts by language, domains, symbols and imports; totals and the first language come of the counts."""
    plan = planned(QUERIES["g16_explore_context"](spark, sf_dir))
    assert plan.count("Bucketed: true") == 4, plan


def test_imports_are_merged_at_every_size(spark, sf_dir):
    """The files of a small table are not broadcast, so that shuffled bytes grow as the table does."""
    for name in ("g17_key_files", "j05_import_resolution", "j06_imported_by", "g16_modify_context", "g16_explore_context"):
        plan = planned(QUERIES[name](spark, sf_dir))
        assert "BroadcastHashJoin [key#" not in plan and "SortMergeJoin [key#" in plan, plan


def test_customers_files_are_written_by_several_tasks(spark, tmp_path):
    """Tasks stage and move; the driver hears of a folder from each."""
    from srcatlas.operators import writers

    rows = spark.range(40).selectExpr("concat('a/f', id) as path", "concat('t', id) as content").repartition(4)
    stage = str(tmp_path / ".staged")
    folders = writers._stage(rows, str(tmp_path), stage)
    assert len(folders) == 4
    assert sorted(path for f in folders for path, _ in writers._staged(f)) == sorted(f"a/f{i}" for i in range(40))
    writers.put(rows, str(tmp_path))
    assert {p.name: p.read_text() for p in (tmp_path / "a").iterdir()} == {f"f{i}": f"t{i}" for i in range(40)}


def test_diffs_are_made_where_the_texts_lie(spark, sf_dir):
    plan = planned(QUERIES["a13_a15_rewritten_diffs"](spark, sf_dir))
    assert "ENSURE_REQUIREMENTS" not in plan


def test_parsing_does_not_fill_the_worker(monkeypatch):
    """Files are parsed in a child process that is replaced; names of parsed files do not stay in the worker."""
    import os

    from srcatlas import parsers

    monkeypatch.setattr(parsers, "CHILD", 2)
    met = []
    monkeypatch.setattr(parsers, "extract", lambda content, *_: [{"what": "symbol", "name": str(os.getpid())}])
    parser = parsers._Parser()
    try:
        for _ in range(6):
            met += [r["name"] for _, r in parser.rows((["a"], ["python"], ["x = 1"], parsers.EVERY))]
    finally:
        parser.close()
    assert len(met) == 6 and str(os.getpid()) not in met and len(set(met)) == 3
    assert parsers._Parser().rows((["a"], ["go"], [""], parsers.EVERY))[0][1]["name"] == str(os.getpid())


def test_python_files_are_parsed_once(spark, sf_dir):
    assert "MapInArrow" not in planned(QUERIES["x07_x08_applied_symbols"](spark, sf_dir))


def test_notes_of_applied_symbols_are_made_once(spark, sf_dir):
    assert "posexplode" not in planned(QUERIES["x07_x08_applied_symbols"](spark, sf_dir))


def test_files_without_rows_stay_in_their_lists(spark):
    from srcatlas import parsers

    files = spark.createDataFrame([("a", "go", None), ("a", "python", "def f(): pass\nclass C:\n    if x:\n        def g(self): pass\n"), ("b", "zig", "x")], "path string, language string, content string")
    found = parsers.nested(files, "symbol").collect()
    assert [(r["path"], [(s["name"], s["line_start"]) for s in r["parsed"]]) for r in found if r["parsed"]] == [("a", [("f", 1), ("C", 2), ("g", 4)])] and len(found) == 3
    assert parsers.nested(files.where("language = 'go'")).first()["parsed"] == []


def test_bodies_are_not_searched_for_literals(monkeypatch):
    from srcatlas.parsers import braces

    monkeypatch.setattr(braces, "_LITERAL", None)
    code = "pub struct S {\n  a: u8,\n}\nimpl S {\n  fn go(&self) { self.run(1) }\n}\n"
    assert [(r["parent"], r["name"]) for r in braces.extract(code, "rust", frozenset({"call"}))] == [("go", "run")]
