import posixpath

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from srcatlas.functions import conditions, docs, paths, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first()["r"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "b", ".", "..", ""]), max_size=7))
def test_normalize_is_stable_and_agrees_with_posix(spark, parts):
    path = "/".join(parts)
    found = one(spark, paths.normalize(F.col("p")), p=path)
    assert one(spark, paths.normalize(F.col("p")), p=found) == found
    expected = posixpath.normpath("/" + path).lstrip("/")
    assert found == expected


def test_parts_and_languages(spark):
    frame = spark.createDataFrame([("src/a/x.test.ts",), ("y.PY",), (".bashrc",), ("a/b/Makefile",)], "p string")
    rows = [tuple(r) for r in frame.select(paths.parent(F.col("p")), paths.stem(F.col("p")), paths.extension(F.col("p")), paths.language(F.col("p"))).collect()]
    assert rows == [("src/a", "x.test", "ts", "typescript"), ("", "y", "py", "python"), ("", ".bashrc", "", None), ("a/b", "Makefile", "", None)]


def test_globs(spark):
    frame = spark.createDataFrame([("a.ts",), ("x/y/a.ts",), ("node_modules/a.ts",), ("x/node_modules/b/a.ts",), ("a.rb",)], "p string")
    kept = [r["p"] for r in frame.where(paths.selected(F.col("p"), ("**/*.ts",), ("**/node_modules/**",))).collect()]
    assert kept == ["a.ts", "x/y/a.ts"]
    assert frame.where(paths.selected(F.col("p"))).count() == 5


@pytest.mark.parametrize(
    ("rule", "value", "passes"),
    [("<0.7", 0.69, True), ("<0.7", 0.7, False), ("<=0.7", 0.7, True), (">0.8", 0.8, False), (">=0.9", 0.9, True), ("=0.5", 0.5001, True), ("=0.5", 0.51, False), (" < 0.5 ", 0.4, True)],
)
def test_confidence_rules(spark, rule, value, passes):
    assert one(spark, conditions.confidence(rule, F.col("c")), c=value) is passes


@pytest.mark.parametrize("rule", ["", "0.5", "<x", "~0.5", "< 0.5 1"])
def test_bad_confidence_rules(rule):
    with pytest.raises(ValueError):
        conditions.confidence(rule, F.col("c"))


def test_states(spark):
    row = {"hacks.count": F.lit(3)}
    assert one(spark, conditions.state("hacks.count >= 3", row), x="") is True
    for bad in ("hacks.count >= x", "nothing > 1", "hacks.count 3", "hacks.count ~ 3"):
        assert one(spark, conditions.state(bad, row), x="") is False


def test_names(spark):
    assert one(spark, text.humanize(F.col("n")), n="userAuth_service-name") == "User auth service name"
    assert one(spark, text.truncated(F.col("n"), 6), n="abcdefgh") == "abc..."
    assert one(spark, text.tokens(F.col("n")), n="é" * 5) == 3


JSDOC = """/**
 * Adds {@link Total}.
 *
 * More.
 * @param {number} a - first
 * @param [b=2] second
 * @returns {number} the sum
 * @throws {TypeError} if not
 * @deprecated use plus
 * @see Other
 * @todo later
 * @example
 * add(1)
 * @private
 */"""
GOOGLE = '''"""Does it.

Args:
    a (int): first
    b: second
        goes on

Returns:
    bool: true

Raises:
    ValueError: never
"""'''
NUMPY = '''"""Does it.

Parameters
----------
a : int
    first

Returns
-------
bool
    true
"""'''
SPHINX = '"""Does it.\n\n:param int a: first\n:param b: second\n:type b: str\n:returns: x\n:rtype: bool\n:raises KeyError: no\n"""'


def test_jsdoc():
    d = docs.parse(JSDOC, "jsdoc")
    assert d["summary"] == "Adds Total." and d["see"] == ["Total", "Other"] and d["deprecated"] == "use plus"
    assert d["params"] == [{"name": "a", "type": "number", "text": "first"}, {"name": "b", "type": None, "text": "second"}]
    assert d["returns"] == {"type": "number", "text": "the sum"} and d["throws"] == [{"type": "TypeError", "text": "if not"}]
    assert d["examples"] == ["add(1)"] and d["todos"] == ["later"] and d["tags"] == [{"name": "private", "value": ""}]


def test_docstrings():
    assert [docs.docstring_style(x) for x in (GOOGLE, NUMPY, SPHINX, "plain")] == ["google", "numpy", "sphinx", "plain"]
    g, n, s = (docs.parse(x, "docstring") for x in (GOOGLE, NUMPY, SPHINX))
    assert g["summary"] == n["summary"] == s["summary"] == "Does it."
    assert g["params"] == [{"name": "a", "type": "int", "text": "first"}, {"name": "b", "type": None, "text": "second goes on"}]
    assert g["returns"] == {"type": "bool", "text": "true"} and g["throws"] == [{"type": "ValueError", "text": "never"}]
    assert n["params"] == [{"name": "a", "type": "int", "text": "first"}] and n["returns"] == {"type": "bool", "text": "true"}
    assert s["params"] == [{"name": "a", "type": "int", "text": "first"}, {"name": "b", "type": "str", "text": "second"}]
    assert s["returns"] == {"type": "bool", "text": "x"} and s["throws"] == [{"type": "KeyError", "text": "no"}]


def test_rustdoc_godoc_javadoc():
    r = docs.parse("/// Pays [`Bill`].\n///\n/// # Arguments\n/// * `x` - amount\n/// # Errors\n/// If broke.\n/// # Examples\n/// ```\n/// # not a title\n/// pay();\n/// ```", "rustdoc")
    assert r["summary"] == "Pays [`Bill`]." and r["see"] == ["Bill"] and r["params"] == [{"name": "x", "type": None, "text": "amount"}]
    assert r["notes"] == ["Errors: If broke."] and r["examples"] == ["# not a title\npay();"]
    g = docs.parse("// Get returns it. It is fast.\n//\n// Deprecated: use Fetch\n// BUG(al): slow\n// TODO(bo): fix\n//\n//\tcode()", "godoc")
    assert g["summary"] == "Get returns it." and g["deprecated"] == "use Fetch" and g["notes"] == ["BUG(al): slow"] and g["todos"] == ["fix"] and g["examples"] == ["code()"]
    j = docs.parse("/**\n * Sends <b>it</b> to {@code x}. Then ends.\n * <pre><code>go();</code></pre>\n * @param m the\n *   message\n * @throws IOException if bad\n */", "javadoc")
    assert j["summary"] == "Sends it to `x`." and j["examples"] == ["go();"] and j["params"] == [{"name": "m", "type": None, "text": "the message"}]
    assert j["throws"] == [{"type": "IOException", "text": "if bad"}]
    assert docs.parse(None, "jsdoc") == docs.parse("x", "nothing") == docs.empty()
