"""Parsers and doc comments by language, lookups, assembled suggestions, and section selection."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import parsers
from ..functions import docs
from ..functions.conditions import state as state_condition
from ..functions.text import truncated
from ..operators import bridge, documents_check, files, lookups, primer, render, rewrite, search, suggestions, validation, variables, writers
from ..schema import MARKER
from ..sources import tree
from ..sources.files import to_annotate
from ..storage import fresh
from .analysis import _THIRD, _VIS, _name_rules, _path_case
from .code import _BASE, _T, _notes
from .derived import VARIABLES, dealt, derived, sources
from .registry import query
from .state import _SECTIONS, r05

_S = "cast(o_orderkey as varchar(40))"
_N = "chr(10)"


def _source(language: str, *lines: str) -> str:
    return f"select concat('m', {_S}) as path, '{language}' as language, concat({f', {_N}, '.join(lines)}, {_N}) as content, o_orderkey, o_orderstatus from orders"


_JS = _source(
    "javascript", "'import b from \"x\";'", f"concat('function f', {_S}, '(x) {{')", "'  return a(x);'", "'}'", f"concat('class K', {_S}, ' {{')",
    "'  go() {'", "'    b.run();'", "'  }'", "'}'", f"concat('export const g', {_S}, ' = (y) => {{')", "'  return 1;'", "'};'",
)
_RUST = _source(
    "rust", "'use std::fmt::Display as D;'", "concat('/// Holds ', o_orderstatus, '.')", f"concat('pub struct S', {_S}, ' {{')", "'}'", f"concat('impl S', {_S}, ' {{')",
    "'    fn go(&self) -> i32 {'", "'        helper(self)'", "'    }'", "'}'", f"concat('pub(crate) fn top', {_S}, '(x: i32) -> i32 {{')", "'    x.run()'", "'}'", f"concat('trait T', {_S}, ' {{}}')",
)
_GO = _source(
    "go", "'package m'", "'import ('", "chr(9) || '\"fmt\"'", "')'", "concat('// Runs ', o_orderstatus, '.')", f"concat('func Run', {_S}, '(a int) int {{')", "chr(9) || 'return fmt.Sum(a)'", "'}'",
    f"concat('type S', {_S}, ' struct {{')", "'}'", f"concat('func (s *S', {_S}, ') low() {{')", "chr(9) || 'helper()'", "'}'",
)
_JAVA = _source(
    "java", "'package a.b;'", "'import java.util.List;'", "concat('/** Holds ', o_orderstatus, '. */')", f"concat('public class C', {_S}, ' {{')", "'    private int go(int x) {'", "'        return List.of(x);'",
    "'    }'", "'    protected void b() {'", "'    }'", "'}'", f"concat('interface I', {_S}, ' {{')", "'}'",
)
_KEPT = ("path", "qualified_name", "kind", "line_start", "line_end", "visibility")


def _expected(source: str, *rows: tuple) -> str:
    """The symbols that a source holds; names as SQL."""
    made = [f"select path, {name} as qualified_name, '{kind}' as kind, {a}::bigint as line_start, {b}::bigint as line_end, '{visibility}' as visibility from s" for name, kind, a, b, visibility in rows]
    return f"with s as ({source}) " + " union all ".join(made)


def _symbols(spark, sf_dir, source: str):
    return parsers.symbols(parsers.parse(sources(spark, sf_dir, source), "symbol")).select(*_KEPT)


_K = "o_orderkey"


@query("x02_javascript_symbols", _expected(_JS, (f"'f' || {_K}", "function", 2, 4, "private"), (f"'K' || {_K}", "class", 5, 9, "private"), (f"'K' || {_K} || '.go'", "method", 6, 8, "public"), (f"'g' || {_K}", "function", 10, 12, "public")))
def x02(spark, sf_dir):
    return _symbols(spark, sf_dir, _JS)


@query("x03_rust_symbols", _expected(_RUST, (f"'S' || {_K}", "struct", 3, 4, "public"), (f"'S' || {_K}", "impl", 5, 9, "private"), (f"'S' || {_K} || '.go'", "method", 6, 8, "private"), (f"'top' || {_K}", "function", 10, 12, "crate"), (f"'T' || {_K}", "trait", 13, 13, "private")))
def x03(spark, sf_dir):
    return _symbols(spark, sf_dir, _RUST)


@query("x05_go_symbols", _expected(_GO, (f"'Run' || {_K}", "function", 6, 8, "public"), (f"'S' || {_K}", "struct", 9, 10, "public"), ("'low'", "method", 11, 13, "private")))
def x05(spark, sf_dir):
    return _symbols(spark, sf_dir, _GO)


@query("x06_java_symbols", _expected(_JAVA, (f"'C' || {_K}", "class", 4, 10, "public"), (f"'C' || {_K} || '.go'", "method", 5, 7, "private"), (f"'C' || {_K} || '.b'", "method", 8, 9, "protected"), (f"'I' || {_K}", "interface", 11, 12, "internal")))
def x06(spark, sf_dir):
    return _symbols(spark, sf_dir, _JAVA)


@query("x03_x05_x06_calls", f"""with r as ({_RUST}), g as ({_GO}), j as ({_JAVA}), x as ({_JS})
select path, 'go' as caller, 'helper' as callee, null as receiver, 7::bigint as line_no from r union all select path, 'top' || {_K}, 'run', 'x', 11 from r
union all select path, 'Run' || {_K}, 'Sum', 'fmt', 7 from g union all select path, 'low', 'helper', null, 12 from g union all select path, 'go', 'of', 'List', 6 from j
union all select path, 'f' || {_K}, 'a', null, 3 from x union all select path, 'go', 'run', 'b', 7 from x""")
def x_calls(spark, sf_dir):
    parsed = [parsers.calls(parsers.parse(sources(spark, sf_dir, s), "call")) for s in (_RUST, _GO, _JAVA, _JS)]
    return parsed[0].unionByName(parsed[1]).unionByName(parsed[2]).unionByName(parsed[3])


@query("x03_x05_x06_imports", f"""with r as ({_RUST}), g as ({_GO}), j as ({_JAVA}), x as ({_JS})
select path, 'std::fmt::Display' as source, 'D' as names, 1::bigint as line_no from r union all select path, 'fmt', 'fmt', 3 from g union all select path, 'java.util.List', 'List', 2 from j union all select path, 'x', 'b', 1 from x""")
def x_imports(spark, sf_dir):
    parsed = [parsers.imports(parsers.parse(sources(spark, sf_dir, s), "import")) for s in (_RUST, _GO, _JAVA, _JS)]
    return parsed[0].unionByName(parsed[1]).unionByName(parsed[2]).unionByName(parsed[3]).withColumn("names", F.array_join("names", ","))


def _comment(*lines: str) -> str:
    return f"select o_orderkey as target, concat({f', {_N}, '.join(lines)}) as text from orders"


_GOOGLE = _comment("concat('Adds ', o_orderstatus, '.')", "''", "'Args:'", f"concat('    a', {_S}, ' (int): the first')", "''", "'Returns:'", "'    int: the sum'", "''", "'Raises:'", "'    ValueError: if bad'")
_SPHINX = _comment("concat('Adds ', o_orderstatus, '.')", "''", f"concat(':param a', {_S}, ': the first')", f"concat(':type a', {_S}, ': int')", "':returns: the sum'", "':raises ValueError: if bad'")
_RUSTDOC = _comment("concat('Opens ', o_orderstatus, '.')", "''", "'# Panics'", "''", f"concat('If ', {_S}, '.')")
_GODOC = _comment("concat('Run does ', o_orderstatus, '.')", "''", f"concat('Deprecated: use Go', {_S}, '.')")
_JAVADOC = _comment("concat('/** Opens ', o_orderstatus, '. More.')", f"concat(' * @param a', {_S}, ' the first')", "' * @throws X if bad'", "' * @since 1.2'", "' */'")


def _parsed(spark, sf_dir, text: str, style: str):
    rows = derived(spark, sf_dir, text)
    return rows.select("target", docs.column(F.col("text"), F.lit(style)).alias("doc"))


_DOCSTRING = "select target, 'Adds ' || o_orderstatus || '.' as summary, 'a' || target as param, 'int' as type, 'the sum' as returns, 'ValueError' as raised from (select o_orderkey as target, o_orderstatus from orders)"


@query("d02_google_docstrings", _DOCSTRING)
def d02(spark, sf_dir, text=_GOOGLE):
    first, thrown = F.get("doc.params", F.lit(0)), F.get("doc.throws", F.lit(0))
    rows = _parsed(spark, sf_dir, text, "docstring")
    return rows.select("target", F.col("doc.summary").alias("summary"), first["name"].alias("param"), first["type"].alias("type"), F.col("doc.returns.text").alias("returns"), thrown["type"].alias("raised"))


@query("d02_sphinx_docstrings", _DOCSTRING)
def d02_sphinx(spark, sf_dir):
    return d02(spark, sf_dir, _SPHINX)


@query("d03_rustdoc", "select o_orderkey as target, 'Opens ' || o_orderstatus || '.' as summary, 'Panics: If ' || o_orderkey || '.' as note from orders")
def d03(spark, sf_dir):
    return _parsed(spark, sf_dir, _RUSTDOC, "rustdoc").select("target", F.col("doc.summary").alias("summary"), F.array_join("doc.notes", "|").alias("note"))


@query("d04_godoc", "select o_orderkey as target, 'Run does ' || o_orderstatus || '.' as summary, 'use Go' || o_orderkey || '.' as deprecated from orders")
def d04(spark, sf_dir):
    return _parsed(spark, sf_dir, _GODOC, "godoc").select("target", F.col("doc.summary").alias("summary"), F.col("doc.deprecated").alias("deprecated"))


@query("d05_javadoc", "select o_orderkey as target, 'Opens ' || o_orderstatus || '.' as summary, 'a' || o_orderkey as param, 'X' as thrown, '1.2' as since from orders")
def d05(spark, sf_dir):
    rows = _parsed(spark, sf_dir, _JAVADOC, "javadoc")
    return rows.select("target", F.col("doc.summary").alias("summary"), F.get("doc.params", F.lit(0))["name"].alias("param"), F.get("doc.throws", F.lit(0))["type"].alias("thrown"), F.col("doc.since").alias("since"))


_NOTED = _comment(
    "'/**'", "' * Adds things.'", f"concat(' * {MARKER}fn \"Adds ', {_S}, '\" kept - Keep it exact')", f"case when o_orderkey % 3 = 0 then concat(' * {MARKER}summary \"Own ', {_S}, '\"') else ' *' end",
    f"concat(' * {MARKER}param {{number}} [a', {_S}, '=3] - the first')", f"' * {MARKER}param b - the second'", f"case when o_orderkey % 2 = 0 then ' * {MARKER}returns {{number}} - the sum' else ' * {MARKER}throws {{RangeError}} - if large' end", "' */'",
)


_BRIDGED = _comment(
    "'/**'", "case when o_orderkey % 4 = 0 then ' *' else concat(' * Adds ', o_orderstatus, '.') end", f"case when o_orderkey % 3 = 0 then concat(' * {MARKER}fn \"Sums ', {_S}, '\" kept - Keep it exact') else ' *' end",
    f"case when o_orderkey % 6 = 0 then concat(' * {MARKER}summary \"Own ', {_S}, '\"') else ' *' end", "case when o_orderkey % 5 = 0 then ' * @returns {number} the sum' else ' *' end", "' */'",
)


def _bridge_sql(both: str) -> str:
    return f"""with d as (select o_orderkey as k, case when o_orderkey % 4 <> 0 then 'Adds ' || o_orderstatus || '.' end as native, case when o_orderkey % 6 = 0 then 'Own ' || o_orderkey when o_orderkey % 3 = 0 then 'Sums ' || o_orderkey end as noted,
o_orderkey % 3 = 0 as said, o_orderkey % 4 <> 0 or o_orderkey % 5 = 0 as told from orders where o_orderkey % 7 <> 0)
select cast(k as varchar) as target, case when native is null then noted when noted is null then native else {both} end as summary, case when said then 'Keep it exact' end as directive,
case when said and told then 'merged' when said then 'explicit' when told then 'converted' end as bridge from d union all select cast(o_orderkey as varchar), null, null, null from orders where o_orderkey % 7 = 0"""


def _bridge(spark, sf_dir, precedence):
    rows = derived(spark, sf_dir, _BRIDGED).select(F.col("target").cast("string").alias("target"), F.lit("typescript").alias("language"), F.when(F.col("target") % 7 != 0, "jsdoc").alias("format"), F.col("text").alias("doc"))
    return bridge.applied(rows, precedence).select("target", "summary", "directive", "bridge")


@query("b10_bridged_symbols", _bridge_sql("native"))
def b10(spark, sf_dir):
    return _bridge(spark, sf_dir, "acp-first")


@query("b10_merged_symbols", _bridge_sql("native || ' ' || noted"))
def b10_merged(spark, sf_dir):
    return _bridge(spark, sf_dir, "merge")


@query("b08_notes_in_docs", """select o_orderkey as target, case when o_orderkey % 3 = 0 then '"Own ' || o_orderkey || '"' else 'Adds ' || o_orderkey end as summary, 'Keep it exact' as directive,
'a' || o_orderkey || ':the first,b:the second' as params, case when o_orderkey % 2 = 0 then 'the sum' end as returns, case when o_orderkey % 2 = 0 then '' else 'RangeError:if large' end as throws from orders""")
def b08(spark, sf_dir):
    made = bridge.noted_in_docs(derived(spark, sf_dir, _NOTED))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit(":"), x["directive"])), ",").alias(c)
    return made.select("target", "summary", "directive", text("params"), "returns", text("throws"))


@query("b12_bridge_status", "select count(*) as symbols, count(*) filter (where p_partkey % 2 = 0 and p_size % 2 = 0) as merged, count(*) filter (where p_partkey % 2 = 0 and p_size % 2 <> 0) as native_only, count(*) filter (where p_partkey % 2 <> 0 and p_size % 2 = 0) as noted_only, count(*) filter (where p_partkey % 2 <> 0 and p_size % 2 <> 0) as bare from part")
def b12(spark, sf_dir):
    return bridge.status(derived(spark, sf_dir, "select p_partkey % 2 = 0 as native, p_size % 2 = 0 as noted from part"))


@query("f01_symbol_by_name", _BASE + "select path, symbol as name from (select distinct path, symbol, opener_line from scoped) where symbol = 'f7'")
def f01(spark, sf_dir):
    return lookups.symbol(files.fold_symbols(_notes(spark, sf_dir)), "f7").select("path", "name")


@query("f05_files_in_domain", _BASE + f"select distinct path from notes where name = 'domain' and {_T} = 'd3'")
def f05(spark, sf_dir):
    return lookups.in_domain(files.fold_files(_notes(spark, sf_dir)), "d3").select("path")


@query("f06_files_in_layer", _BASE + f"select path from (select path, max_by({_T}, line_no) filter (where name = 'layer') as layer from notes group by path) where layer = 'handler'")
def f06(spark, sf_dir):
    return lookups.in_layer(files.fold_files(_notes(spark, sf_dir)), "handler").select("path")


@query("f10_state_conditions", "select s_suppkey, s_suppkey % 7 > 2 as many, s_suppkey % 5 == 0 as none, s_suppkey % 7 <> 3 as other, false as odd from supplier")
def f10(spark, sf_dir):
    rows = derived(spark, sf_dir, "select s_suppkey, s_suppkey % 7 as frozen, s_suppkey % 5 as hacks from supplier")
    facts = {"constraints.frozen_count": F.col("frozen"), "hacks.count": F.col("hacks")}
    asked = {"many": "constraints.frozen_count > 2", "none": "hacks.count == 0", "other": "constraints.frozen_count != 3", "odd": "hacks.count near 0"}
    return rows.select("s_suppkey", *[state_condition(text, facts).alias(name) for name, text in asked.items()])


@query("f11_capabilities", """select s_suppkey, (s_suppkey % 3 = 0 or s_suppkey % 3 = 1) and (s_suppkey % 4 <> 1) as offered from supplier""")
def f11(spark, sf_dir):
    rows = derived(spark, sf_dir, "select s_suppkey from supplier")
    some = F.when(F.col("s_suppkey") % 3 == 1, F.array(F.lit("shell"), F.lit("web"))).when(F.col("s_suppkey") % 3 == 2, F.array(F.lit("web")))
    every = F.when(F.col("s_suppkey") % 4 == 1, F.array(F.lit("shell"), F.lit("web"))).when(F.col("s_suppkey") % 4 == 2, F.array(F.lit("files")))
    return rows.select("s_suppkey", primer.capable(some, every, ["shell", "files"]).alias("offered"))


@query("f12_variable_search", f"with v as ({VARIABLES}) select name from v where type = 'file' and (contains(lower(value), 'small') or contains(lower(coalesce(description, '')), 'small'))")
def f12(spark, sf_dir):
    return lookups.variables_of(derived(spark, sf_dir, VARIABLES), "file", "Small").select("name")


@query("h07_cut_summaries", "select p_partkey, case when length(p_name) > 12 then left(p_name, 9) || '...' else p_name end as short from part")
def h07(spark, sf_dir):
    rows = derived(spark, sf_dir, "select p_partkey, p_name from part")
    return rows.select("p_partkey", truncated(F.col("p_name"), 12).alias("short"))


@query("j15_tool_overlap", "select s_suppkey as key, 'in tools and exclude: ' || case when s_suppkey % 4 = 0 then 'a, b' else 'b' end as message from supplier where s_suppkey % 2 = 0")
def j15(spark, sf_dir):
    rows = derived(spark, sf_dir, "select s_suppkey as key from supplier")
    tools = F.array(F.lit("b"), F.lit("a"))
    left_out = F.when(F.col("key") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("key") % 2 == 0, F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("c")))
    return validation.tool_overlap(rows.select("key", tools.alias("tools"), left_out.alias("exclude")))


@query("j09_callee_variables", f"""with s as (select o_orderkey as k from orders)
select 'SYM_F' || s.k as name, coalesce('SYM_F' || t.k, '') as refs from s left join s t on t.k = s.k * 7 % 1000""")
def j09(spark, sf_dir):
    rows = derived(spark, sf_dir, "select o_orderkey as k from orders")
    name = F.concat(F.lit("f"), F.col("k").cast("string"))
    symbols = rows.select(name.alias("name"), F.concat(F.lit("m:"), name).alias("qualified_name"), F.lit(None).cast("string").alias("summary"), F.lit("m").alias("path"), F.lit(True).alias("exported"))
    calls = rows.select(name.alias("caller"), F.concat(F.lit("f"), (F.col("k") * 7 % 1000).cast("string")).alias("callee"))
    none = rows.limit(0).select(F.lit("").alias("path"), F.lit("").alias("module"), F.lit("").alias("summary"), F.lit("").alias("layer"), F.array().cast("array<string>").alias("domains"))
    made = variables.generate(symbols, none, calls)
    return made.select("name", F.array_join("refs", ",").alias("refs"))


_HEURISTIC = """select concat('src/', case p_partkey % 4 when 0 then 'auth' when 1 then 'billing' when 2 then 'db' else 'plain' end, '/m', cast(p_partkey as varchar(40)), '.ts') as path,
case when p_partkey % 6 = 5 then concat('src/', case p_partkey % 4 when 0 then 'auth' when 1 then 'billing' when 2 then 'db' else 'plain' end, '/m', cast(p_partkey as varchar(40)), '.ts')
else concat(case p_partkey % 6 when 0 then 'getUserToken' when 1 then 'saveOrder' when 2 then 'isReady' when 3 then 'RouteHandler' else 'processItem' end, cast(p_partkey as varchar(40))) end as target,
cast(p_size as bigint) as line, case when p_partkey % 6 = 5 then null when p_partkey % 6 = 3 then 'class' else 'function' end as kind,
case p_partkey % 5 when 0 then 'private' when 1 then 'protected' when 2 then 'internal' when 3 then 'crate' else 'public' end as visibility, p_partkey % 2 = 0 as exported from part"""

#: All heuristics of the targets, in the order in which they are asked: h(n, target, line, kind, value, confidence).
_FOUND = f"""all_targets as ({_HEURISTIC}), s as (select * from all_targets where kind is not null), f as (select * from all_targets where kind is null),
p as (select target, line, unnest(string_split(lower(path), '/')) as part from s), w as (select target, line, kind, list_filter(string_split(regexp_replace(regexp_replace(target, '([A-Z])', ' \\1', 'g'), '^ ', ''), ' '), lambda x : x <> '') as w from s),
made as (select target, line, kind, case when kind = 'function' then {_THIRD} || ' ' || array_to_string(list_transform(w[2:], lambda x : lower(x)), ' ') else upper(w[1][1]) || substr(array_to_string(list_transform(w, lambda x : lower(x)), ' '), 2) end as made from w),
h as (select 1 as n, target, line, 'module' as kind, 'M' || substr(regexp_extract(path, '/([^/]*)[.]ts$', 1), 2) as value, 0.7::double as confidence from f union all select 1, target, line, 'summary', 'M' || substr(regexp_extract(path, '/([^/]*)[.]ts$', 1), 2) || ' module', 0.5 from f
union all select 2, * from ({_name_rules()}) union all select distinct 3, target, line, 'domain', {_path_case(suggestions.DOMAINS)}, 0.7::double from p where {_path_case(suggestions.DOMAINS)} is not null
union all select distinct 3, target, line, 'layer', {_path_case(suggestions.LAYERS)}, 0.6::double from p where {_path_case(suggestions.LAYERS)} is not null
union all select 4, * from ({_VIS} union all select target, line, 'lock', 'normal', 0.5::double from s where visibility = 'public' and exported)
union all select 5, target, line, 'summary', case when len(made) < 5 or regexp_matches(made, '(eses|sses)(\\s|$)|  ') then upper(target[1]) || substr(lower(target), 2) || ' ' || kind else made end, 0.6::double from made)
"""


@query("a11_all_heuristics", f"with {_FOUND} select target, line, kind, value, confidence from h")
def a11(spark, sf_dir):
    return suggestions.heuristic(derived(spark, sf_dir, _HEURISTIC)).select("target", "line", "kind", "value", "confidence")


@query("a05_assembled_suggestions", f"""with {_FOUND}, c as (select target, line, 'summary' as kind, 'Said ' || line as value from all_targets where line % 3 = 0),
one as (select target, kind, count(distinct value) as n, min(value) as value from h group by all having count(distinct value) = 1)
select target, kind, 'converted' as source, value from c union all select target, kind, 'heuristic', value from one where kind in ('module', 'summary', 'domain', 'lock', 'layer') and not (kind = 'summary' and exists (select 1 from c where c.target = one.target))""")
def a05(spark, sf_dir):
    targets = derived(spark, sf_dir, _HEURISTIC)
    said = targets.where(F.col("line") % 3 == 0).select("target", "line", F.lit("summary").alias("kind"), F.concat(F.lit("Said "), F.col("line").cast("string")).alias("value"), F.lit(0.9).alias("confidence"), F.lit("converted").alias("source"), F.lit(0).cast("long").alias("ord"))
    found = suggestions.heuristic(targets)
    clear = found.groupBy("target", "kind").agg(F.count_distinct("value").alias("n")).where("n = 1")
    made = suggestions.assemble(said, found, "standard").select("target", "kind", "source", "value")
    # where heuristics disagree the first counts, which the SQL leaves to the query of priorities
    return made.where("source = 'converted'").unionByName(made.where("source = 'heuristic'").join(clear.drop("n"), ["target", "kind"], "left_semi"))


@query("g28_section_listing", "select 's' || p_partkey as id, coalesce(case when p_partkey % 2 = 0 then p_name end, 's' || p_partkey) as name, p_brand as category, cast(p_size as bigint) as tokens, p_partkey % 3 = 0 as required from part")
def g28(spark, sf_dir):
    rows = derived(spark, sf_dir, "select concat('s', cast(p_partkey as varchar(40))) as id, case when p_partkey % 2 = 0 then p_name end as name, p_brand as category, cast(p_size as bigint) as tokens, p_partkey % 3 = 0 as required from part")
    return primer.listing(rows.withColumn("capabilities", F.array(F.lit("shell")))).drop("capabilities")


@query("s02_annotate_scan", """with f as (select concat('/srv/app/', case c_custkey % 3 when 0 then 'src' when 1 then 'lib' else 'node_modules/x' end, '/m', cast(c_custkey as varchar(40)), case c_custkey % 4 when 0 then '.ts' when 1 then '.py' when 2 then '.txt' else '.go' end) as path from customer)
select path from f where regexp_matches(path, '[.](ts|py|go)$') and not contains(path, '/node_modules/') and contains(path, '/src/')""")
def s02(spark, sf_dir):
    rows = derived(spark, sf_dir, "select concat('/srv/app/', case c_custkey % 3 when 0 then 'src' when 1 then 'lib' else 'node_modules/x' end, '/m', cast(c_custkey as varchar(40)), case c_custkey % 4 when 0 then '.ts' when 1 then '.py' when 2 then '.txt' else '.go' end) as path from customer")
    return to_annotate(rows, ("**/*.ts", "**/*.py", "**/*.go"), ("**/node_modules/**",), "**/src/**")


_TREE = """select concat(case c_custkey % 5 when 0 then 'src/a' when 1 then 'src/b/c' when 2 then 'node_modules/x' when 3 then 'src/node_modules/y' else 'docs' end, '/m', cast(c_custkey as varchar(40)), case c_custkey % 4 when 0 then '.ts' when 1 then '.py' when 2 then '.txt' else '.go' end) as path,
concat('// ', c_name, chr(10), c_mktsegment, chr(10)) as content from customer"""


def _tree(spark, sf_dir):
    """The customers' files, written to the shared folder."""
    made = fresh(spark)
    if re.match(r"(?!file:)\w+:", made):
        raise ValueError("a source tree lies in a mounted folder")
    root = re.sub("^file:/*", "/", made)
    writers.put(dealt(derived(spark, sf_dir, _TREE), "path"), root)
    return root


@query("s01_tree_source", f"""select path, content, cast(strlen(content) as bigint) as length, case regexp_extract(path, '[.](.*)$', 1) when 'ts' then 'typescript' when 'py' then 'python' else 'go' end as language
from ({_TREE}) where regexp_matches(path, '[.](ts|py|go)$') and not contains(path, 'node_modules/') and starts_with(path, 'src/')""")
def s01_tree(spark, sf_dir):
    found = tree.scan(spark, _tree(spark, sf_dir), ("**/*.ts", "**/*.py", "**/*.go"), ("**/node_modules/**",))
    return found.where(F.col("path").startswith("src/")).select("path", "content", "length", "language")


@query("s01_listed_folders", """select * from (values ('', 0::bigint, 2::bigint), ('src', 0, 2), ('src/b', 0, 1)) v(path, files, folders)
union all select p, count(*), 0 from (select regexp_replace(path, '/[^/]*$', '') as p, path from (""" + _TREE + """)) where not contains(path, 'node_modules') group by p""")
def s01_listed(spark, sf_dir):
    return tree.read(spark, _tree(spark, sf_dir), (), ("**/node_modules/**",), table="folders")


_DOCUMENTS = """select case s_suppkey % 5 when 0 then 'my.cache.json' when 1 then 'a.vars.json' when 2 then 'x.json' when 3 then 'the.attempts.json' else 'y.cache.json' end as kind, s_suppkey,
case s_suppkey % 5 when 0 then concat('{"files":{"f', cast(s_suppkey as varchar(40)), '":{"path":"p","language":"', case when s_suppkey % 2 = 0 then 'cobol' else 'python' end, '","lines":', cast(s_suppkey % 7 - 1 as varchar(40)), '}}}')
when 1 then concat('{"variables":{"V":{"type":"', case when s_suppkey % 2 = 0 then 'odd' else 'symbol' end, '"}}}') when 2 then '{"a":1}' when 3 then '{"attempts":{"a":{"status":"lost"}}}' else '{"files":' end as json from supplier"""


@query("c04_validated_documents", f"""with d as ({_DOCUMENTS}) select s_suppkey || ':' || kind as name, 'cache' as kind, 'f' || s_suppkey as key, 'unknown language' as message from d where s_suppkey % 5 = 0 and s_suppkey % 2 = 0
union all select s_suppkey || ':' || kind, 'cache', 'f' || s_suppkey, 'negative lines' from d where s_suppkey % 5 = 0 and s_suppkey % 7 = 0
union all select s_suppkey || ':' || kind, 'vars', 'V', 'unknown type' from d where s_suppkey % 5 = 1 and s_suppkey % 2 = 0 union all select s_suppkey || ':' || kind, 'vars', 'V', 'value is missing' from d where s_suppkey % 5 = 1
union all select s_suppkey || ':' || kind, null, null, 'is of no known kind' from d where s_suppkey % 5 = 2 union all select s_suppkey || ':' || kind, 'attempts', 'a', 'unknown status' from d where s_suppkey % 5 = 3
union all select s_suppkey || ':' || kind, 'cache', null, 'is no JSON object' from d where s_suppkey % 5 = 4""")
def c04(spark, sf_dir):
    rows = derived(spark, sf_dir, _DOCUMENTS)
    return validation.validate(rows.select(F.concat(F.col("s_suppkey").cast("string"), F.lit(":"), "kind").alias("name"), "json"))


@query("f07_posting_search", "select n_nationkey as q, p_partkey as id, p_name as name from nation join part on contains(lower(p_name), lower(substr(n_name, 1 + n_nationkey % 3, 1 + n_nationkey % 4)))")
def f07_postings(spark, sf_dir):
    names = derived(spark, sf_dir, "select p_partkey as id, p_name as name from part")
    patterns = spark.sql("select n_nationkey as q, substr(n_name, 1 + n_nationkey % 3, 1 + n_nationkey % 4) as pattern from nation")
    return search.search(search.index(names), names, patterns)


_WHOLE = """select c_custkey as k, concat(cast(c_custkey as varchar(40)), case c_custkey % 6 when 0 then '.config.json' when 1 then '.sync.json' when 2 then '.primer.json' when 3 then '.cache.json' when 4 then '.vars.json' else '.attempts.json' end) as name,
concat('{', case when c_custkey % 11 = 0 then '' when c_custkey % 13 = 0 then '"version":"one",' else '"version":"1.0.0",' end, case c_custkey % 6
when 0 then concat('"strictness":"', case when c_custkey % 4 = 0 then 'odd' else 'strict' end, '","defaults":{"lock":"', case when c_custkey % 5 = 0 then 'shut' else 'normal' end, '"}')
when 1 then concat('"tools":["cursor","', case when c_custkey % 5 = 0 then 'vim' else 'aider' end, '"],"debounceMs":', cast(c_custkey % 9 - 1 as varchar(40)))
when 2 then concat('"sections":[{"id":"s", "category":"c","tokens":1,"value":{}', case when c_custkey % 4 = 0 then ',"formats":{}' when c_custkey % 5 = 0 then '' else ',"formats":{"md":{}}' end, case when c_custkey % 7 = 0 then ',"conflictsWith":["s"]' else '' end, '}]')
when 3 then concat('"generated_at":"x","project":{},"stats":{},"symbols":{},"files":{"f', cast(c_custkey as varchar(40)), '":{"language":"', case when c_custkey % 4 = 1 then 'cobol' else 'go' end, '","lines":', cast(c_custkey % 8 - 1 as varchar(40)), '}}')
when 4 then concat('"variables":[{"type":"', case when c_custkey % 4 = 0 then 'odd' else 'symbol' end, '"', case when c_custkey % 5 = 0 then '' else ',"value":"v"' end, '}]')
else concat('"attempts":{"a":{"status":"active","files":[{"hash":"', case when c_custkey % 7 = 0 then 'bad' else md5('x') end, '"}]}},"history":[{"started_at":"2024-01-0', cast(c_custkey % 9 + 1 as varchar(40)), 'T00:00:00Z","ended_at":"2024-01-05T00:00:00Z"}]') end, case when c_custkey % 17 = 0 then '' else '}' end) as json from customer"""


@query("c01_document_rules", f"""with d as (select k, name, k % 6 as m, split_part(name, '.', 2) as kind from ({_WHOLE})), ok as (select * from d where k % 17 <> 0),
r(name, kind, spot, message) as (select name, kind, '', 'is no JSON object' from d where k % 17 = 0
union all select name, kind, '', 'version is missing' from ok where k % 11 = 0 union all select name, kind, '', 'version is no version' from ok where k % 13 = 0 and k % 11 <> 0
union all select name, kind, '', 'unknown strictness' from ok where m = 0 and k % 4 = 0 union all select name, kind, 'defaults', 'unknown lock level' from ok where m = 0 and k % 5 = 0
union all select name, kind, 'tools.1', 'unknown tool' from ok where m = 1 and k % 5 = 0 union all select name, kind, '', 'debounceMs is no count' from ok where m = 1 and k % 9 = 0
union all select name, kind, 'sections.0', 'formats is empty' from ok where m = 2 and k % 4 = 0 union all select name, kind, 'sections.0', 'formats is missing' from ok where m = 2 and k % 4 <> 0 and k % 5 = 0
union all select name, kind, 'sections.0', 'conflicts with itself' from ok where m = 2 and k % 7 = 0 union all select name, kind, 'files.f' || k, 'unknown language' from ok where m = 3 and k % 4 = 1
union all select name, kind, 'files.f' || k, 'lines is no count' from ok where m = 3 and k % 8 = 0 union all select name, kind, 'variables.0', 'unknown type' from ok where m = 4 and k % 4 = 0
union all select name, kind, 'variables.0', 'value is missing' from ok where m = 4 and k % 5 = 0 union all select name, kind, 'attempts.a.files.0', 'hash is no MD5' from ok where m = 5 and k % 7 = 0
union all select name, kind, 'history.0', 'ended before it started' from ok where m = 5 and k % 9 > 4) select * from r""")
def c01_rules(spark, sf_dir):
    return documents_check.check(derived(spark, sf_dir, _WHOLE))


@query("s05_variant_entries", f"""select name, case when k % 6 = 4 then '0' end as key, 'symbol' as type, case when k % 5 <> 0 then 'v' end as value from ({_WHOLE}) where k % 6 = 4 and k % 17 <> 0 and k % 4 <> 0
union all select name, '0', 'odd', case when k % 5 <> 0 then 'v' end from ({_WHOLE}) where k % 6 = 4 and k % 17 <> 0 and k % 4 = 0""")
def s05_entries(spark, sf_dir):
    held = documents_check.table_of(derived(spark, sf_dir, _WHOLE), "variables")
    return held.select("name", "key", *[F.try_variant_get("entry", f"$.{c}", "string").alias(c) for c in ("type", "value")])


_TEXTS = "select cast(s_suppkey as varchar(40)) as path, case s_suppkey % 4 when 0 then '' when 1 then concat('head', chr(10), chr(10)) when 2 then concat('head', chr(10), '<b>', chr(10), 'old', chr(10), '<e>', chr(10), 'tail') else concat('<e> odd <b>', chr(10)) end as existing, concat('new ', cast(s_suppkey as varchar(40))) as section from supplier"


@query("k09_marker_merge", f"""with t as ({_TEXTS}), b as (select *, concat('<b>', chr(10), section, chr(10), '<e>') as block, cast(path as int) % 4 as k from t)
select path, case k when 0 then block when 1 then concat('head', chr(10), chr(10), block) when 2 then concat('head', chr(10), chr(10), chr(10), block, chr(10), chr(10), 'tail') else concat('<e> odd <b>', chr(10), chr(10), block) end as content from b""")
def k09(spark, sf_dir):
    return rewrite.merge_texts(derived(spark, sf_dir, _TEXTS), "section", "<b>", "<e>")


@query("k09_append", f"with t as ({_TEXTS}) select path, rtrim(existing, chr(10)) || chr(10) || chr(10) || section as content from t")
def k09_append(spark, sf_dir):
    return rewrite.merge_texts(derived(spark, sf_dir, _TEXTS), "append", "<b>", "<e>")


@query("k11_file_trees", """with f as (select c_custkey as k, 'src/m' || c_custkey || '.ts' as path, case when c_custkey % 3 = 0 then 'frozen' end as level, case when c_custkey % 2 = 0 then 'Does ' || c_custkey end as purpose from customer)
select path, 'm' || k || '.ts' || coalesce(' (' || level || ')', '') || coalesce(chr(10) || '  ' || purpose, '') || case when k % 5 = 0 then '' else chr(10) || '  ├─ a' || k || ' (fn:' || (k % 9 + 1) || ')' || chr(10) || '  └─ b (class:20)' || case when k % 3 = 0 then ' [frozen]' else '' end end as text from f""")
def k11(spark, sf_dir):
    made = derived(spark, sf_dir, "select c_custkey as k, concat('src/m', cast(c_custkey as varchar(40)), '.ts') as path, case when c_custkey % 3 = 0 then 'frozen' end as level, case when c_custkey % 2 = 0 then concat('Does ', cast(c_custkey as varchar(40))) end as purpose from customer")
    some = made.where("k % 5 <> 0")
    two = some.select("path", F.lit("b").alias("name"), F.lit("class").alias("type"), F.lit(20).cast("long").alias("line"), (F.col("k") % 3 == 0).alias("frozen"))
    one = some.select("path", F.concat(F.lit("a"), F.col("k").cast("string")).alias("name"), F.lit("fn").alias("type"), (F.col("k") % 9 + 1).cast("long").alias("line"), F.lit(False).alias("frozen"))
    return render.file_trees(made.select("path", "level", "purpose"), two.unionByName(one))


@query("k11_symbol_refs", "select o_orderkey as k, 'f' || o_orderkey || ' (' || case o_orderkey % 3 when 0 then 'fn' when 1 then 'iface' else 'class' end || ':' || (o_orderkey % 50) || '-' || (o_orderkey % 50 + 9) || ')' as text from orders")
def k11_refs(spark, sf_dir):
    rows = derived(spark, sf_dir, "select o_orderkey as k, concat('f', cast(o_orderkey as varchar(40))) as name, case o_orderkey % 3 when 0 then 'function' when 1 then 'interface' else 'class' end as kind, o_orderkey % 50 as line from orders")
    return rows.select("k", render.symbol_ref(F.col("name"), F.col("kind"), F.col("line"), F.col("line") + 9).alias("text"))


@query("a13_a15_rewritten_diffs", f"""with o as (select o_orderkey as k, case o_orderkey % 3 when 0 then 'python' when 1 then 'go' else 'java' end as language from orders)
select 'm' || k as path, '--- a/m' || k || chr(10) || '+++ b/m' || k || chr(10) || case language when 'java' then '@@ -1,2 +1,5 @@' else '@@ -1,2 +1,3 @@' end || chr(10) || ' one' || chr(10) ||
case language when 'python' then '+# {MARKER}lock normal' when 'go' then '+// {MARKER}lock normal' else '+/**' || chr(10) || '+ * {MARKER}lock normal' || chr(10) || '+ */' end || chr(10) || ' two' as diff from o""")
def a13(spark, sf_dir):
    rows = dealt(derived(spark, sf_dir, "select concat('m', cast(o_orderkey as varchar(40))) as path, case o_orderkey % 3 when 0 then 'python' when 1 then 'go' else 'java' end as language, concat('one', chr(10), 'two') as content from orders"), "path")
    none = F.lit(None).cast("long")
    wanted = rows.select("path", F.lit("t").alias("target"), F.lit(2).cast("long").alias("line"), F.lit(f"{MARKER}lock normal").alias("text"), F.lit(False).alias("is_file"), none.alias("doc_start"), none.alias("doc_end"), F.lit(0).alias("ord"))
    return rewrite.preview(rows, rewrite.plan(wanted)).select("path", "diff")


#: The selection of every catalogue, one section a step: each phase walks its list, made when it begins.
_SELECTED = f"""with recursive raw as ({_SECTIONS}),
own as (select *, case m when 1 then least(safety + 200, 255) when 2 then safety // 2 else safety end as safety_now, case m when 2 then efficiency // 2 else efficiency end as efficiency_now,
case m when 2 then accuracy // 2 else accuracy end as accuracy_now, case m when 1 then base when 2 then 255 else 0 end as base_now from raw),
s as (select id, catalogue, ord, tokens, safety, required, wanted, priority, safety_now * 2.5::double + efficiency_now * 0.8::double + accuracy_now * 1.0::double + base_now * 0.8::double as value,
case when ord % 11 = 0 then ['s' || (ord - 5)] else [] end as depends, case when ord % 13 = 0 then ['s' || (ord + 5)] else [] end as conflicts from own),
listed as (select catalogue, list({{'id': id, 'tokens': tokens, 'safety': safety, 'required': required, 'wanted': wanted, 'value': value, 'density': value / tokens, 'depends': depends, 'conflicts': conflicts}} order by ord) as every,
list({{'id': id, 'tokens': tokens, 'safety': safety, 'required': required, 'wanted': wanted, 'value': value, 'density': value / tokens, 'depends': depends, 'conflicts': conflicts}} order by value desc, ord) as by_value,
list({{'id': id, 'tokens': tokens, 'safety': safety, 'required': required, 'wanted': wanted, 'value': value, 'density': value / tokens, 'depends': depends, 'conflicts': conflicts}} order by value / tokens desc, ord) as by_density from s group by catalogue),
walk as (select catalogue, 1 as phase, list_filter(every, lambda x : x.required) as todo, 2000::bigint as spare, 0::bigint as spent, []::varchar[] as taken, []::varchar[] as phases, []::varchar[] as barred from listed
union all select w.catalogue, w.phase + (len(w.todo) = 0)::int,
case when len(w.todo) > 0 then w.todo[2:] when w.phase = 1 then list_filter(l.every, lambda x : x.wanted and not list_contains(w.taken, x.id) and not list_contains(w.barred, x.id))
when w.phase = 2 then list_filter(l.by_value, lambda x : x.safety >= 80 and not list_contains(w.taken, x.id) and not list_contains(w.barred, x.id)) else list_filter(l.by_density, lambda x : not list_contains(w.taken, x.id) and not list_contains(w.barred, x.id)) end,
case when fits then w.spare - w.todo[1].tokens else w.spare end, case when len(w.todo) = 0 then 0 when fits then w.spent + w.todo[1].tokens else w.spent end,
case when fits then list_append(w.taken, w.todo[1].id) else w.taken end, case when fits then list_append(w.phases, ['required', 'conditional', 'safety', 'value'][w.phase]) else w.phases end,
case when fits then list_concat(w.barred, w.todo[1].conflicts) else w.barred end
from (select *, coalesce(len(todo) > 0 and todo[1].tokens <= spare and (phase <> 3 or spent + todo[1].tokens <= 800) and (phase < 3 or list_has_all(taken, todo[1].depends)), false) as fits from walk) w join listed l on l.catalogue = w.catalogue where w.phase < 4 or len(w.todo) > 0),
ends as (select * from walk where phase = 4 and len(todo) = 0), picked as (select catalogue, unnest(taken) as id, unnest(phases) as phase, unnest(range(len(taken))) as step from ends)
select p.catalogue, row_number() over (partition by p.catalogue order by s.priority, p.step) - 1 as "at", p.id, s.tokens, p.phase from picked p join s on s.id = p.id"""


query("r05_section_selection", _SELECTED)(r05)
