import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from srcatlas.operators import annotations, files
from srcatlas.schema import DIRECTIVES, LOCK_DIRECTIVES
from srcatlas.schema import MARKER as M


@pytest.fixture
def parsed(spark):
    def run(text, strict=False):
        lines = annotations.lines(spark.createDataFrame([("a.ts", text)], "path string, content string"))
        return [r.asDict() for r in annotations.annotations(lines, strict).orderBy("line_no").collect()]

    return run


def test_lines_like_a_line_reader(spark):
    texts = ["", "a", "a\n", "a\n\n", "a\r\nb", "\n"]
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    counted = {r["path"]: r["n"] for r in frame.select("path", annotations.line_count(frame["content"]).alias("n")).collect()}
    listed = {}
    for r in annotations.lines(frame).orderBy("line_no").collect():
        listed.setdefault(r["path"], []).append(r["text"])
    for i, t in enumerate(texts):
        expected = [x[:-1] if x.endswith("\r") else x for x in t.split("\n")]
        expected = expected[:-1] if expected[-1] == "" else expected
        assert listed.get(str(i), []) == expected and counted[str(i)] == len(expected)


def test_values_directives_and_defaults(parsed):
    rows = parsed(f"// {M}lock frozen\n// {M}lock approval-required - ask Bob\n/* {M}domain billing */\n// {M}hack\n// {M}ref http://x\n// {M}unknown v")
    assert [(r["name"], r["value"]) for r in rows] == [("lock", "frozen"), ("lock", "approval-required"), ("domain", "billing"), ("hack", None), ("ref", "http://x"), ("unknown", "v")]
    assert [r["directive"] for r in rows] == [LOCK_DIRECTIVES["frozen"], "ask Bob", None, DIRECTIVES["hack"], "Consult http://x before making changes", None]
    assert [r["auto_generated"] for r in rows] == [True, False, True, True, True, True]


def test_strict_values_hold_no_hyphen(parsed):
    assert parsed(f"// {M}lock approval-required", strict=True) == []


def test_continuations(parsed):
    rows = parsed(f"// {M}fn \"f\" - first\n//   second\n//   third\n// other\n//   stray\n// {M}lock normal\n//  only")
    assert [r["directive"] for r in rows] == ["first second third", "only"]
    assert [r["auto_generated"] for r in rows] == [False, False]


def test_provenance_stops_at_code_and_at_other_annotations(spark):
    text = "\n".join(
        [f"// {M}summary \"a\"", f"// {M}source heuristic", f"// {M}source-confidence 1.7", f"// {M}source-reviewed true", f"// {M}source-id \"gen-1\"", f"// {M}domain d", "code()", f"// {M}source refined", f"// {M}lock normal"]
    )
    lines = annotations.lines(spark.createDataFrame([("a", text)], "path string, content string"))
    found = {r["name"]: r for r in annotations.with_provenance(lines).collect()}
    assert (found["summary"]["source"], found["summary"]["confidence"], found["summary"]["reviewed"], found["summary"]["generation_id"]) == ("heuristic", 1.0, True, "gen-1")
    assert not found["domain"]["has_marker"] and found["domain"]["source"] == "explicit"
    kept = {r["key"]: r for r in annotations.provenance_map(annotations.with_provenance(lines)).collect()}
    assert kept[f"{M}domain"]["reviewed"] and not kept[f"{M}domain"]["needs_review"]


def test_symbol_scopes_and_fields(spark, parsed):
    text = "\n".join(
        [f"// {M}summary \"file\"", f"// {M}class \"C\" - the class", f"// {M}summary \"of C\"", f"// {M}calls a, b", f"// {M}pure", f"// {M}param {{T}} [n=1] - it", f"// {M}method", f"// {M}summary \"file again\"", f"// {M}domain d1"]
    )
    lines = annotations.lines(spark.createDataFrame([("p", text)], "path string, content string"))
    notes = annotations.annotations(lines)
    symbols = files.fold_symbols(notes).collect()
    assert [(s["name"], s["summary"], s["type"], s["calls"], s["pure"]) for s in symbols] == [("C", "of C", "class", ["a", "b"], True)]
    folded = files.fold_files(notes).first()
    assert folded["summary"] == "file again" and folded["domains"] == ["d1"] and folded["exports"] == ["C"]
    tag = files.type_tags(notes).first()
    assert (tag["name"], tag["type"], tag["optional"], tag["default"], tag["directive"]) == ("n", "T", True, "1", "it")


WORD = st.text(alphabet="abcXYZ09_", min_size=1, max_size=8)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["domain", "layer", "owner"]), WORD, st.one_of(st.none(), WORD)), max_size=6))
def test_what_is_written_is_read_back(parsed, notes):
    text = "\n".join(f"// {M}{n} {v}" + (f" - {d}" if d else "") for n, v, d in notes)
    assert [(r["name"], r["value"], r["directive"]) for r in parsed(text)] == notes


def test_migration_joins_nothing(spark):
    from srcatlas.operators import annotations
    from srcatlas.schema import MARKER

    held = f"// {MARKER}lock frozen\r\nx\n\n// {MARKER}lock odd - said\n"
    rows = spark.createDataFrame([("a", held), ("b", "plain\n"), ("c", None), ("d", f"// {MARKER}no-such-kind\n")], "path string, content string")
    made = annotations.migrated(rows)
    told = made.collect()
    assert [r.path for r in told] == ["a"] and told[0].before == held
    lines = told[0].after.split("\n")
    assert lines[0].startswith(f"// {MARKER}lock frozen - ") and lines[1:] == ["x", "", f"// {MARKER}lock odd - said"]
    assert "Join" not in made._jdf.queryExecution().sparkPlan().toString()
    script = annotations.migration_script(rows)
    assert "Join" not in script._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r.place[0], r.sign) for r in script.collect()) == [(1, "+"), (1, "-"), (2, " "), (3, " "), (4, " ")]
