"""Parsed sources, guardrails, rewriting and stored documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import parsers
from ..operators import annotations as notes
from ..operators import constraints, files, rewrite
from ..schema import MARKER
from ..sources import documents
from ..storage import written
from .code import _BASE, _kept_notes, _notes
from .derived import derived, sources
from .registry import query

_S = "cast(o_orderkey as varchar(40))"
_QUOTES = '"' * 3
_PY = (
    f"select concat('m', {_S}, '.py') as path, 'python' as language, concat('import os', chr(10), 'class C', {_S}, ':', chr(10), '    def run(self):', chr(10), "
    f"'        return helper', cast(o_orderkey % 7 as varchar(40)), '(self)', chr(10), 'def _f', {_S}, '(a):', chr(10), '    {_QUOTES}Adds ', o_orderstatus, '.{_QUOTES}', chr(10), "
    f"'    return os.path.join(a)', chr(10)) as content, o_orderkey, o_orderstatus from orders"
)
_TS = f"""select concat('m', {_S}, '.ts') as path, 'typescript' as language, concat('import {{ a, b as c }} from "./m', cast(o_orderkey % 9 as varchar(40)), '";', chr(10), 'export class K', {_S}, ' {{', chr(10), '  private go(x: string) {{', chr(10), '    return a(x);', chr(10), '  }}', chr(10), '}}', chr(10),
'export function top', {_S}, '() {{', chr(10), '  c.run();', chr(10), '}}', chr(10)) as content, o_orderkey from orders""".replace("{{", "{").replace("}}", "}")


@query("x04_python_symbols", f"""with s as ({_PY}) select path, 'C' || o_orderkey as qualified_name, 'class' as kind, 2::bigint as line_start, 4::bigint as line_end, 'public' as visibility, null as doc from s
union all select path, 'C' || o_orderkey || '.run', 'method', 3, 4, 'public', null from s union all select path, '_f' || o_orderkey, 'function', 5, 7, 'protected', 'Adds ' || o_orderstatus || '.' from s""")
def x04(spark, sf_dir):
    return parsers.symbols(parsers.parse(sources(spark, sf_dir, _PY), "symbol")).select("path", "qualified_name", "kind", "line_start", "line_end", "visibility", "doc")


@query("x04_python_calls", f"""with s as ({_PY}) select path, 'run' as caller, 'helper' || (o_orderkey % 7) as callee, null as receiver, 4::bigint as line_no from s union all select path, '_f' || o_orderkey, 'join', 'os.path', 7 from s""")
def x04_calls(spark, sf_dir):
    return parsers.calls(parsers.parse(sources(spark, sf_dir, _PY), "call"))


@query("x01_typescript_symbols", f"""with s as ({_TS}) select path, 'K' || o_orderkey as qualified_name, 'class' as kind, 2::bigint as line_start, 6::bigint as line_end, 'public' as visibility from s
union all select path, 'K' || o_orderkey || '.go', 'method', 3, 5, 'private' from s union all select path, 'top' || o_orderkey, 'function', 7, 9, 'public' from s""")
def x01(spark, sf_dir):
    return parsers.symbols(parsers.parse(sources(spark, sf_dir, _TS), "symbol")).select("path", "qualified_name", "kind", "line_start", "line_end", "visibility")


@query("x01_typescript_imports", f"with s as ({_TS}) select path, './m' || (o_orderkey % 9) as source, 'a,c' as names, 1::bigint as line_no from s")
def x01_imports(spark, sf_dir):
    return parsers.imports(parsers.parse(sources(spark, sf_dir, _TS), "import")).withColumn("names", F.array_join("names", ","))


@query("x07_x08_applied_symbols", _BASE + f""", py as ({_PY}) select 'src/x/' || path as path, '_f' || o_orderkey as name, 'function' as type, coalesce('Adds ' || o_orderstatus || '.', '') as summary from py
union all select 'src/x/' || path, 'C' || o_orderkey, 'class', null from py union all select 'src/x/' || path, 'run', 'method', null from py
union all select path, symbol, case opener when 'class' then 'class' else 'function' end, max_by(trim(value, '"'), line_no) filter (where name = 'summary' and line_no > opener_line) from scoped where symbol is not null group by path, symbol, opener, opener_line""")
def x08(spark, sf_dir):
    parsed = files.ast_symbols(parsers.symbols(parsers.parse(sources(spark, sf_dir, _PY), "symbol")).withColumn("path", F.concat(F.lit("src/x/"), "path")))
    asked = ("path", "name", "type", "line_start", "summary")
    noted = files.fold_symbols(_notes(spark, sf_dir)).select(*asked)
    # written, as symbols are asked for twice on both sides: files are read and parsed once
    return files.apply_ast(written(noted), written(parsed.select(*asked))).select("path", "name", "type", "summary")


_GUARDED = f"""select concat('g', {_S}) as path, concat('// {MARKER}requires a', {_S}, ', b', chr(10), '// {MARKER}forbids eval', chr(10), '// {MARKER}style s', cast(o_orderkey % 3 as varchar(40)), ' http://u', chr(10),
case when o_orderkey % 2 = 0 then '// {MARKER}ai-readonly reason:core' else 'x = 1' end) as content, o_orderkey from orders"""


@query("p14_guardrails", f"""with g as ({_GUARDED}) select path, 1::bigint as line_no, 'requires' as kind, 'a' || o_orderkey as one, null as two from g union all select path, 1, 'requires', 'b', null from g
union all select path, 2, 'forbids', 'eval', null from g union all select path, 3, 'style', 's' || (o_orderkey % 3), 'http://u' from g union all select path, 4, 'ai-readonly', 'core', null from g where o_orderkey % 2 = 0""")
def p14(spark, sf_dir):
    return constraints.guardrails(notes.lines(sources(spark, sf_dir, _GUARDED))).drop("three")


@query("f19_enforcement", f"""with g as ({_GUARDED}) select path, 'forbids' as kind, 'eval' as rule, 'violation' as what, 'error' as severity from g where o_orderkey % 5 = 0 union all select path, 'ai-readonly', 'core', 'violation', 'error' from g where o_orderkey % 2 = 0""")
def f19(spark, sf_dir):
    guarded = sources(spark, sf_dir, _GUARDED)
    rules = constraints.guardrails(notes.lines(guarded))
    changes = guarded.select("path", F.when(F.col("o_orderkey") % 5 == 0, "y = eval(x)").otherwise("y = x").alias("content"))
    return constraints.enforce(changes, rules.select("path", "kind", "one"))


@query("a16_rewritten_files", f"""with s as ({_PY}) select path, replace(replace(content, 'class C', '# {MARKER}lock normal' || chr(10) || 'class C'), 'def _f', '# {MARKER}summary "s"' || chr(10) || 'def _f') as content from s""")
def a16(spark, sf_dir):
    code = sources(spark, sf_dir, _PY)
    none = F.lit(None).cast("long")
    one = code.select("path", F.lit("C").alias("target"), F.lit(2).cast("long").alias("line"), F.lit(f"{MARKER}lock normal").alias("text"))
    two = code.select("path", F.lit("f").alias("target"), F.lit(5).cast("long").alias("line"), F.lit(f'{MARKER}summary "s"').alias("text"))
    wanted = one.unionByName(two).select("*", F.lit(False).alias("is_file"), none.alias("doc_start"), none.alias("doc_end"), F.lit(0).alias("ord"))
    made = rewrite.preview(code.select("path", "language", "content"), rewrite.plan(wanted))
    return made.select("path", F.concat("content", F.lit("\n")).alias("content"))


@query("k01_s05_document_round_trip", "select 'v' || p_partkey as key, 'symbol' as type, p_name as value, case when p_partkey % 2 = 0 then p_brand end as description from part")
def k01(spark, sf_dir):
    rows = derived(spark, sf_dir, "select concat('v', cast(p_partkey as varchar(40))) as key, 'symbol' as type, p_name as value, case when p_partkey % 2 = 0 then p_brand end as description from part")
    lines = documents.entries(rows, "key").select(F.concat(F.lit('{"variables":{'), F.regexp_replace(F.to_json(F.array("key")), r"^\[|\]$", ""), F.lit(":"), "entry", F.lit("}}")).alias("json"))
    return documents.variables(lines).select("key", "type", "value", "description")


@query("s05_file_table", _BASE + """, f as (select path, max_by(trim(value, '"'), line_no) filter (where name = 'module') as module from notes group by path) select path, module from f""")
def s05(spark, sf_dir):
    made = files.fold_files(_notes(spark, sf_dir)).select(F.col("path").alias("key"), "module", "exports")
    lines = documents.entries(made, "key").select(F.concat(F.lit('{"files":{"'), "key", F.lit('":'), "entry", F.lit("}}")).alias("json"))
    return documents.files(lines).select(F.col("key").alias("path"), "module")


@query("g25_issues_below", _BASE + "select path, line_no, name as type from notes where name in ('hack', 'todo') and path like 'src/auth/%'")
def g25(spark, sf_dir):
    from ..operators.lookups import issues_below

    return issues_below(files.issues(_notes(spark, sf_dir)), "src/auth/").select("path", "line_no", "type")


@query("j07_exported_symbols", _BASE + "select path, trim(value, '\"') as name, path as defined_in, case name when 'class' then 'class' else 'function' end as type from notes where name in ('fn', 'class')")
def j07(spark, sf_dir):
    from ..operators.lookups import exported_symbols

    found = _kept_notes(spark, sf_dir)
    return exported_symbols(files.fold_files(found), files.fold_symbols(found))


@query("j13_first_domain", _BASE + "select path, min(trim(value, '\"')) as domain from notes where name = 'domain' group by path")
def j13(spark, sf_dir):
    from ..operators.lookups import first_domain

    return first_domain(files.fold_files(_notes(spark, sf_dir)))


@query("f15_expired_hacks", _BASE + r"""select path, line_no from notes where name = 'hack' and regexp_extract(value, 'expires=(\S+)', 1) < '2024-05-01'""")
def f15(spark, sf_dir):
    return constraints.expired(files.hacks(files.issues(_notes(spark, sf_dir))), "2024-05-01").select("path", "line_no")


@query("g23_project_state", _BASE + r""", l as (select path, max_by(value, line_no) filter (where name = 'lock') as level from notes group by path), h as (select regexp_extract(value, 'expires=(\S+)', 1) as e from notes where name = 'hack')
select count(*) filter (where level = 'frozen') as frozen, count(*) filter (where level = 'restricted') as restricted, count(*) filter (where level in ('frozen', 'restricted')) as protected,
(select count(*) from h) as hacks, (select count(*) from h where e < '2024-05-01') as expired, (select count(distinct value) from notes where name = 'domain') as domains from l""")
def g23(spark, sf_dir):
    from ..operators import stats
    from .state import _ATTEMPTS

    found = _kept_notes(spark, sf_dir)
    made = files.fold_files(found)
    sessions = spark.sql(_ATTEMPTS).select("status")
    state = stats.project_state(stats.lock_row(made), files.hacks(files.issues(found)), sessions, made, "2024-05-01")
    return state.select("frozen", "restricted", "protected", "hacks", "expired", "domains")


@query("t04_event_windows", "select cast(epoch_us(date_trunc('hour', ts)) as bigint) as start_us, event_type, count(*) as n from events group by all")
def t04(spark, sf_dir):
    from ..streaming.watch import event_windows

    rows = derived(spark, sf_dir, "select ts, event_type from events")
    return event_windows(rows.withColumn("ts", F.col("ts").cast("timestamp"))).select(F.unix_micros("start").alias("start_us"), "event_type", "n")
