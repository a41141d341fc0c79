"""File analysis from texts to annotated texts, and contexts for creating and debugging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import analysis, contexts, conventions, files, graph, rewrite, suggestions
from ..schema import MARKER as M
from .analysis import _LANG, _PARENT, _SUFFIX
from .code import _BASE, _T, _files, _kept_notes
from .derived import derived, sources
from .registry import query

_S = "cast(o_orderkey as varchar(40))"
_HEAD = f"""case when o_orderkey % 3 = 0 then concat('// {M}module "M ', {_S}, '"') else '// plain' end, chr(10), repeat(chr(10), case when o_orderkey % 2 = 0 then 22 else 2 end), '/**', chr(10)"""
_MIDDLE = f"""' * Does step ', cast(o_orderkey % 11 as varchar(40)), '.', chr(10), case when o_orderkey % 4 = 0 then concat(' * {M}summary "s"', chr(10)) else '' end, ' */', chr(10),
'export function top', {_S}, '() {{', chr(10), '  run();', chr(10), '}}', chr(10), 'function hidden', {_S}, '() {{', chr(10), '}}', chr(10)""".replace("{{", "{").replace("}}", "}")
_TAIL = f"case when o_orderkey % 5 = 0 then concat('@Injectable()', chr(10)) else '' end, 'export class K', {_S}, ' {{', chr(10), '}}'".replace("{{", "{").replace("}}", "}")
_PATH = f"concat(case when o_orderkey % 7 = 0 then 'auth/' else '' end, 'm', {_S}, '.ts')"
#: path, language, content: a documented function, a private one and a class, with annotations here and there.
_CODE = f"select {_PATH} as path, 'typescript' as language, concat({_HEAD}, {_MIDDLE}, {_TAIL}, chr(10)) as content from orders"

#: Where things stand: the comment from d to e, the function below it, the class six lines below e or one more.
_PLACES = """with p as (select o_orderkey as k, case when o_orderkey % 7 = 0 then 'auth/' else '' end || 'm' || o_orderkey || '.ts' as path, case when o_orderkey % 2 = 0 then 24 else 4 end::bigint as d from orders),
q as (select *, d + 2 + (k % 4 = 0)::int as e from p)"""


def _analysis(spark, sf_dir):
    return analysis.analyze(sources(spark, sf_dir, _CODE).select("path", "language", "content"))


@query("a01_existing_annotations", _PLACES + """ select path, 1::bigint as line_no, case when d = 24 then path else 'top' || k end as target, 'module' as kind, 'M ' || k as value from q where k % 3 = 0
union all select path, d + 2, 'top' || k, 'summary', 's' from q where k % 4 = 0""")
def a01(spark, sf_dir):
    return _analysis(spark, sf_dir).existing.select("path", "line_no", "target", "kind", "value")


@query("a02_file_gaps", _PLACES + """ select path, 'top' || k as target, e + 1 as line, e + 1 as insertion_line, 'function' as symbol_kind, d as doc_start, e as doc_end, case when k % 4 = 0 then '' else 'summary,' end || 'domain,lock,layer,deprecated' as missing from q
union all select path, 'K' || k, e + 6 + (k % 5 = 0)::int, e + 6, 'class', null, null, 'summary,domain,lock,layer,deprecated' from q
union all select path, path, 1, 1, null, null, null, case when k % 3 = 0 and d = 24 then '' else 'module,' end || 'summary,domain' from q""")
def a02(spark, sf_dir):
    return _analysis(spark, sf_dir).gaps.select("path", "target", "line", "insertion_line", "symbol_kind", "doc_start", "doc_end", F.array_join("missing", ",").alias("missing"))


@query("a02_file_coverage", _PLACES + """, c as (select path, (k % 3 = 0)::bigint + (k % 4 = 0)::bigint as existing from q) select path, existing, 3::bigint as missing, 100.0::double * existing / (existing + 3) as coverage from c""")
def a02_coverage(spark, sf_dir):
    return _analysis(spark, sf_dir).coverage


_DOMAIN = suggestions.DOMAINS["auth"]
_OWNED = f"case when o_orderkey % 7 = 0 then concat(' * {M}domain {_DOMAIN}', chr(10)) else '' end, ' * {M}lock normal', chr(10)"
_WHOLE = f"""'/**', chr(10), case when o_orderkey % 6 = 0 then '' else concat(' * {M}module "M', {_S}, '"', chr(10)) end, ' * {M}summary "M', {_S}, ' module"', chr(10), ' */', chr(10)"""
_SAID = f"""case when o_orderkey % 4 = 0 then '' else concat(' * {M}summary "Does step ', cast(o_orderkey % 11 as varchar(40)), '."', chr(10)) end, {_OWNED}"""
_CLASS = f"""'/**', chr(10), case when o_orderkey < 10 then '' else concat(' * {M}summary "K', {_S}, case when o_orderkey < 1000 then ' class' else '' end, '"', chr(10)) end, {_OWNED}, ' */', chr(10)"""


@query("j12_a14_annotated_files", f"select {_PATH} as path, concat({_WHOLE}, {_HEAD}, {_SAID}, {_MIDDLE}, {_CLASS}, {_TAIL}) as content from orders")
def j12(spark, sf_dir):
    code = sources(spark, sf_dir, _CODE).select("path", "language", "content")
    found = analysis.suggest(analysis.analyze(code).gaps, code)
    return rewrite.rewritten(code, analysis.changes(found))


_DIRS = "case c_custkey % 6 when 0 then 'src/auth' when 1 then 'src/api/routes' when 2 then 'lib/db' when 3 then 'tests/unit' when 4 then 'src/auth/deep' else 'src/auth/deep/er' end"
_ENDING = "case when c_custkey % 6 in (0, 1) then '.service.ts' when c_custkey % 6 = 4 then case c_custkey % 4 when 0 then '.go' else '.rs' end else case c_custkey % 5 when 0 then '.ts' when 1 then '.py' else '.tsx' end end"
_PAGES = f"select concat({_DIRS}, '/m', cast(c_custkey as varchar(40)), {_ENDING}) as path from customer"


@query("g16_create_context", f"""with f as ({_PAGES}), o as (select path, {_PARENT} as folder, regexp_extract(path, '([^/]*)$', 1) as name from f), s as (select folder, name, {_SUFFIX} as suffix from o),
c as (select folder, suffix, count(*) as n from s group by all), w as (select folder, sum(n) as files, max(struct_pack(n := n, s := suffix)) as top from c group by folder),
v as (select folder, '*' || top.s as pattern from w where files >= 3 and top.n / files >= 0.7),
g as (select folder, {_LANG} as language, count(*) as n from o group by all), m as (select folder, min_by(language, (-n, language)) as language from g group by folder),
x as (select folder, list_sort(list(distinct path))[1:5] as paths from o group by folder)
select x.folder, m.language, (select max_by(v.pattern, len(v.folder)) from v where v.folder = x.folder or starts_with(x.folder, v.folder || '/')) as pattern, array_to_string(x.paths, ',') as "similar" from x left join m using (folder)""")
def g16_create(spark, sf_dir):
    found = derived(spark, sf_dir, _PAGES).select("path", paths.language(F.col("path")).alias("language"))
    return contexts.create(found, conventions.naming(found.select("path"))).select("folder", "language", "pattern", F.array_join("similar", ",").alias("similar"))


_CALLED = f"""e as (select path, symbol as caller, trim(unnest(string_split(value, ','))) as callee from scoped where name = 'calls'), h as (select callee, count(*) as n from e group by callee order by n desc, callee limit 10),
y as (select distinct path, symbol as name, case opener when 'class' then 'class' when 'method' then 'method' else 'function' end as type, opener_directive as purpose, opener_line from scoped where symbol is not null),
i as (select path, list_sort(list(distinct trim(spec))) as related from (select path, unnest(string_split({_T}, ',')) as spec from notes where name = 'imports') group by path)"""


@query("g16_debug_context", _BASE + f""", {_CALLED}, t as (select path, string_agg(name || ' ' || type || ' ' || coalesce(purpose, ''), ',' order by name) as symbols, array_to_string(list_sort(list(distinct name) filter (where name in (select callee from h))), ',') as hot from y group by path)
select f.path, array_to_string(coalesce(i.related, []), ',') as related, t.symbols, coalesce(t.hot, '') as hotpaths from code_files f left join i using (path) left join t using (path)""")
def g16_debug(spark, sf_dir):
    found = _kept_notes(spark, sf_dir)
    rows = contexts.debug(files.fold_files(found), files.fold_symbols(found), graph.hotpaths(files.call_edges(found)))
    told = F.array_join(F.transform("symbols", lambda s: F.concat_ws(" ", s["name"], s["type"], F.coalesce(s["purpose"], F.lit("")))), ",")
    return rows.select("path", F.array_join(F.array_sort(F.array_distinct("related")), ",").alias("related"), told.alias("symbols"), F.array_join("hotpaths", ",").alias("hotpaths"))


@query("g16_debug_symbol_context", _BASE + f""", {_CALLED} select y.name as target, y.path, y.type, y.purpose, array_to_string(coalesce(i.related, []), ',') as related,
array_to_string(coalesce((select list(callee order by n desc, callee) from h where contains(h.callee, y.name)), [])[1:3], ',') as hotpaths from y left join i using (path)""")
def g16_debug_symbol(spark, sf_dir):
    found = _kept_notes(spark, sf_dir)
    rows = contexts.debug_symbol(files.fold_files(found), files.fold_symbols(found), graph.hotpaths(files.call_edges(found)))
    return rows.select("target", "path", "type", "purpose", F.array_join(F.array_sort(F.array_distinct("related")), ",").alias("related"), F.array_join("hotpaths", ",").alias("hotpaths"))
