"""Annotations, files, symbols and graphs of the derived sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import annotations as notes
from ..operators import files, graph, stats
from ..schema import DIRECTIVES, EXTENSIONS, IMPORT_EXTENSIONS, LOCK_DIRECTIVES, LOCK_LEVELS, MARKER, ORIGINS
from ..storage import bucketed
from .derived import CALL_EDGES, CODE_FILES, PROVENANCE, code_files, derived, tasks
from .registry import query


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_files(spark, sf_dir)


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.annotations(notes.lines(_files(spark, sf_dir)))


def _kept_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotations written once by path, for queries that read them several times."""
    found = _notes(spark, sf_dir)
    # counted as the table lies: its dealt out rows would be shuffled for it
    return bucketed(found, "path", tasks(derived(spark, sf_dir, "select o_orderkey from orders")))


def _case(table: dict[str, str], column: str) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


def _grab(pattern: str, group: int, text: str = "text") -> str:
    return f"nullif(trim(regexp_extract({text}, '{pattern}', {group})), '')"


_BASE = f"""with code_files as ({CODE_FILES}),
lines as (select path, unnest(string_split(content, chr(10))) as text, cast(unnest(range(1, len(string_split(content, chr(10))) + 1)) as bigint) as line_no from code_files),
raw as (select path, line_no, {_grab(notes.PATTERN, 1)} as name, {_grab(notes.PATTERN, 2)} as value, {_grab(notes.PATTERN, 3)} as own from lines where contains(text, '{MARKER}')),
more as (select path, line_no, trim(regexp_extract(text, '{notes.CONTINUATION}', 1)) as added from lines where regexp_matches(text, '{notes.CONTINUATION}')),
said as (select r.path, r.line_no, r.name, r.value, nullif(trim(concat_ws(' ', r.own, m.added)), '') as own from raw r left join more m on m.path = r.path and m.line_no = r.line_no + 1),
notes as (select path, line_no, name, value, coalesce(own, case when name = 'lock' then {_case(LOCK_DIRECTIVES, "coalesce(value, 'normal')")} when name = 'purpose' then trim(value, '"') else {_case(DIRECTIVES, "name")} end) as directive, own is null as auto_generated from said),
opened as (select *, last_value(case when name in ('symbol', 'fn', 'function', 'class', 'method') then {{'l': line_no, 's': trim(value, '"'), 'n': name, 'd': directive}} end ignore nulls) over (partition by path order by line_no rows between unbounded preceding and current row) as o from notes),
scoped as (select * exclude (o), o.l as opener_line, o.s as symbol, o.n as opener, o.d as opener_directive from opened)
"""


@query("s01_scan_globs", f"""with code_files as ({CODE_FILES}) select path from code_files
where regexp_matches(path, '\\.(ts|py|go)$') and not regexp_matches(path, '(^|/)utils/')""")
def s01(spark, sf_dir):
    found = _files(spark, sf_dir).select("path")
    return found.where(paths.selected(F.col("path"), ("**/*.ts", "**/*.py", "**/*.go"), ("**/utils/**",)))


@query("s03_project_probe", f"""with code_files as ({CODE_FILES}), l as (select case regexp_extract(path, '\\.([a-z]+)$', 1) {' '.join(f"when '{k}' then '{v}'" for k, v in EXTENSIONS.items())} end as language,
len(content) - len(replace(content, chr(10), '')) + 1 as lines from code_files)
select language, count(*) as files, cast(sum(lines) as bigint) as lines, 100.0::double * count(*) / sum(count(*)) over () as share from l group by language""")
def s03(spark, sf_dir):
    counted = _files(spark, sf_dir).select(paths.language(F.col("path")).alias("language"), notes.line_count(F.col("content")).alias("lines"))
    return stats.languages(counted)


@query("p01_annotation_lines", _BASE + "select path, line_no, name, value, own as directive from raw")
def p01(spark, sf_dir):
    return notes.raw_annotations(notes.lines(_files(spark, sf_dir)))


@query("p02_p03_directives", _BASE + "select path, line_no, name, value, directive, auto_generated from notes")
def p02(spark, sf_dir):
    return _notes(spark, sf_dir)


_LAST = "max_by({v}, line_no) filter (where name = '{n}' and {v} is not null{x})"
_T = "trim(value, '\"')"


@query("p04_file_fold", _BASE + f"""select path, {_LAST.format(v=_T, n='module', x='')} as module, {_LAST.format(v=_T, n='summary', x=' and symbol is null')} as summary,
{_LAST.format(v=_T, n='layer', x='')} as layer, {_LAST.format(v=_T, n='lock', x='')} as lock, max_by(directive, line_no) filter (where name = 'lock') as lock_directive,
string_agg({_T}, ',' order by line_no) filter (where name = 'domain') as domains,
string_agg(name || coalesce(': ' || {_T}, ''), ',' order by line_no) filter (where name like 'ai-%') as ai_hints,
string_agg(replace(value, ', ', ','), ',' order by line_no) filter (where name = 'imports') as imports,
string_agg({_T}, ',' order by line_no) filter (where name in ('fn', 'class')) as exports, count(*) as annotations from scoped group by path""")
def p04(spark, sf_dir):
    made = files.fold_files(_notes(spark, sf_dir))
    text = lambda c: F.nullif(F.array_join(c, ","), F.lit("")).alias(c)
    return made.select("path", "module", "summary", "layer", "lock", "lock_directive", *[text(c) for c in ("domains", "ai_hints", "imports", "exports")], "annotations")


@query("p05_symbol_scopes", _BASE + "select path, line_no, name, symbol, coalesce(opener_line, 0) as symbol_line, opener from scoped")
def p05(spark, sf_dir):
    return files.scoped(_notes(spark, sf_dir)).select("path", "line_no", "name", "symbol", F.coalesce("symbol_line", F.lit(0).cast("long")).alias("symbol_line"), "opener")


@query("p06_p09_symbols", _BASE + f"""select path, symbol as name, path || ':' || symbol as qualified_name, case opener when 'class' then 'class' when 'method' then 'method' else 'function' end as type,
opener_line as line_start, opener_line + 10 as line_end, max(opener_directive) as purpose, max_by({_T}, line_no) filter (where name = 'summary' and value is not null and line_no > opener_line) as summary,
coalesce(bool_or(name = 'pure'), false) as pure, max_by(coalesce(directive, {_T}), line_no) filter (where name = 'deprecated') as deprecated,
string_agg(replace(value, ', ', ','), ',' order by line_no) filter (where name = 'calls') as calls,
string_agg(coalesce(directive, {_T}), ',' order by line_no) filter (where name = 'todo') as todos from scoped where symbol is not null group by path, symbol, opener, opener_line""")
def p06(spark, sf_dir):
    made = files.fold_symbols(_notes(spark, sf_dir))
    text = lambda c: F.nullif(F.array_join(c, ","), F.lit("")).alias(c)
    return made.select("path", "name", "qualified_name", "type", "line_start", "line_end", "purpose", "summary", "pure", "deprecated", text("calls"), text("todos"))


@query("p07_call_edges", _BASE + "select symbol as caller, trim(unnest(string_split(value, ','))) as callee, path, line_no from scoped where name = 'calls'")
def p07(spark, sf_dir):
    return files.call_edges(_notes(spark, sf_dir))


@query("p08_type_tags", _BASE + r"""select path, symbol, line_no, case name when 'return' then 'returns' else name end as tag,
case name when 'param' then regexp_extract(value, '\[([^=\]]*)', 1) when 'template' then regexp_extract(value, '^(\S+)', 1) end as name,
case when name <> 'template' then regexp_extract(value, '^\{([^}]*)\}', 1) end as type, name = 'param' as optional,
case name when 'param' then regexp_extract(value, '=([^\]]*)\]', 1) end as "default", case name when 'template' then regexp_extract(value, ' extends (.*)$', 1) end as "constraint", directive
from scoped where name in ('param', 'returns', 'template')""")
def p08(spark, sf_dir):
    return files.type_tags(_notes(spark, sf_dir))


@query("p10_inline_issues", _BASE + r"""select path, line_no, name as type, value, directive, auto_generated,
case name when 'hack' then nullif(regexp_extract(value, 'expires=(\S+)', 1), '') end as expires, case name when 'hack' then nullif(regexp_extract(value, 'ticket=(\S+)', 1), '') end as ticket,
case name when 'hack' then nullif(regexp_extract(value, '"([^"]*)"', 1), '') end as reason from notes where name in ('hack', 'todo', 'fixme', 'critical', 'perf')""")
def p10(spark, sf_dir):
    return files.issues(_notes(spark, sf_dir))


@query("p11_ai_hints", _BASE + f"select path, line_no, name || ': ' || {_T} as hint from notes where name like 'ai-%'")
def p11(spark, sf_dir):
    rows = _notes(spark, sf_dir).where(F.col("name").isin(*files.HINTS))
    return rows.select("path", "line_no", F.concat_ws(": ", "name", F.regexp_replace("value", '"', "")).alias("hint"))


_SOURCED = f"""bounds as (select n.path, n.line_no, n.name, n.value, (select min(l.line_no) from lines l where l.path = n.path and l.line_no > n.line_no
and (not regexp_matches(trim(l.text), '^(//|\\*|#|/\\*)') or (contains(l.text, '{MARKER}') and not contains(l.text, '{MARKER}source')))) as stop from notes n where not starts_with(n.name, 'source')),
found as (select b.path, b.line_no, b.name, b.value,
max_by({_grab(notes.SOURCE, 1, 'l.text')}, l.line_no) filter (where {_grab(notes.SOURCE, 1, 'l.text')} is not null) as source,
max_by({_grab(notes.CONFIDENCE, 1, 'l.text')}, l.line_no) filter (where {_grab(notes.CONFIDENCE, 1, 'l.text')} is not null) as confidence,
max_by({_grab(notes.REVIEWED, 1, 'l.text')}, l.line_no) filter (where {_grab(notes.REVIEWED, 1, 'l.text')} is not null) as reviewed
from bounds b left join lines l on l.path = b.path and l.line_no > b.line_no and l.line_no <= coalesce(b.stop, 1000000) group by b.path, b.line_no, b.name, b.value)
"""


@query("p12_provenance", _BASE + "," + _SOURCED + """select path, line_no, name, value, coalesce(source, confidence, reviewed) is not null as has_marker, coalesce(source, 'explicit') as source,
cast(confidence as double) as confidence, reviewed = 'true' as reviewed from found""")
def p12(spark, sf_dir):
    return notes.with_provenance(notes.lines(_files(spark, sf_dir))).drop("generation_id")


@query("p13_provenance_map", _BASE + "," + _SOURCED + f"""select path, '{MARKER}' || name as key, value, coalesce(source, 'explicit') as source, cast(confidence as double) as confidence,
coalesce(cast(confidence as double) < 0.8, false) as needs_review, case when coalesce(source, confidence, reviewed) is null then true else coalesce(reviewed = 'true', false) end as reviewed
from (select *, row_number() over (partition by path, name order by line_no desc) as r from found) where r = 1""")
def p13(spark, sf_dir):
    return notes.provenance_map(notes.with_provenance(notes.lines(_files(spark, sf_dir)))).drop("generation_id")


@query("p15_legacy_annotations", f"""with code_files as ({CODE_FILES}), lines as (select path, unnest(string_split(content, chr(10))) as text, cast(unnest(range(1, len(string_split(content, chr(10))) + 1)) as bigint) as line_no from code_files),
f as (select path, line_no, text, nullif(regexp_extract(text, '{MARKER}([\\w-]+)(?:\\s+(.+))?', 1), '') as name, nullif(trim(regexp_extract(text, '{MARKER}([\\w-]+)(?:\\s+(.+))?', 2)), '') as value from lines where contains(text, '{MARKER}') and not contains(text, ' - ')),
g as (select *, case when name = 'lock' then {_case(LOCK_DIRECTIVES, "coalesce(value, 'normal')")} else {_case(DIRECTIVES, "name")} end as directive from f)
select path, line_no, text, name, value, directive, text || ' - ' || directive as rewritten from g where directive is not null""")
def p15(spark, sf_dir):
    return notes.legacy(notes.lines(_files(spark, sf_dir)))


@query("g01_totals", _BASE + """, f as (select count(*) as files, cast(sum(len(content) - len(replace(content, chr(10), '')) + 1) as bigint) as lines from code_files),
s as (select count(*) as symbols, count(summary) as summed from (select path, symbol, opener_line, max(case when name = 'summary' and line_no > opener_line then value end) as summary from scoped where symbol is not null group by all))
select files, symbols, lines, 100.0::double * summed / symbols as coverage from f, s""")
def g01(spark, sf_dir):
    code = _files(spark, sf_dir)
    counted = code.select("path", notes.line_count(F.col("content")).alias("lines"))
    return stats.totals(counted, files.fold_symbols(notes.annotations(notes.lines(code))))


@query("g02_hotpaths", f"with e as ({CALL_EDGES}) select callee, count(*) as calls from e group by callee order by calls desc, callee limit 10")
def g02(spark, sf_dir):
    return graph.hotpaths(derived(spark, sf_dir, CALL_EDGES))


@query("g03_call_graph", f"with e as ({CALL_EDGES}) select callee, array_to_string(list_sort(list(caller)), ',') as callers, count(distinct caller) as distinct_callers from e group by callee")
def g03(spark, sf_dir):
    rows = graph.callers(derived(spark, sf_dir, CALL_EDGES))
    return rows.select("callee", F.array_join("callers", ",").alias("callers"), F.size(F.array_distinct("callers")).cast("long").alias("distinct_callers"))


@query("f04_callees", f"with e as ({CALL_EDGES}) select caller, array_to_string(list_sort(list(distinct callee)), ',') as callees from e group by caller")
def f04(spark, sf_dir):
    return graph.callees(derived(spark, sf_dir, CALL_EDGES)).select("caller", F.array_join("callees", ",").alias("callees"))


@query("g04_domain_rollup", _BASE + f"""select {_T} as domain, count(distinct path) as files, min(path) as first_file from notes where name = 'domain' group by {_T}""")
def g04(spark, sf_dir):
    return stats.domains(files.fold_files(_notes(spark, sf_dir)))


_LEVEL = f"case when lock in ({', '.join(repr(x) for x in LOCK_LEVELS)}) then lock else 'normal' end"
_LOCKS = f"""locks as (select path, max_by(value, line_no) filter (where name = 'lock') as lock, max_by(directive, line_no) filter (where name = 'lock') as directive, bool_or(name like 'ai-%') as hinted from notes group by path)"""


@query("g05_lock_levels", _BASE + f", {_LOCKS} select {_LEVEL} as level, count(*) as files from locks where lock is not null or hinted group by all")
def g05(spark, sf_dir):
    return stats.lock_levels(stats.lock_row(files.fold_files(_notes(spark, sf_dir))))


@query("g05_constraint_rows", _BASE + f""", {_LOCKS} select path, {_LEVEL} as level, directive, {_LEVEL} = 'approval-required' as requires_approval, {_LEVEL} = 'tests-required' as requires_tests,
{_LEVEL} = 'docs-required' as requires_docs from locks where lock is not null or hinted""")
def g05_rows(spark, sf_dir):
    return stats.lock_row(files.fold_files(_notes(spark, sf_dir)))


@query("g06_hacks", _BASE + r"""select path || ':' || line_no as id, path, line_no, regexp_extract(value, '"([^"]*)"', 1) as reason, regexp_extract(value, 'ticket=(\S+)', 1) as ticket,
cast(regexp_extract(value, 'expires=(\S+)', 1) as date)::varchar as expires from notes where name = 'hack'""")
def g06(spark, sf_dir):
    return files.hacks(files.issues(_notes(spark, sf_dir))).withColumn("expires", F.col("expires").cast("string"))


_N = ", ".join(f"count(*) filter (where source = '{o}') as n_{o}" for o in ORIGINS)
_AVG = ", ".join(f"round(avg(confidence) filter (where source = '{o}'), 6) as avg_{o}" for o in ORIGINS)


@query("g07_provenance_stats", f"with p as ({PROVENANCE}) select count(*) as total, {_N}, count(*) filter (where needs_review) as needs_review, count(*) filter (where reviewed) as reviewed, {_AVG} from p")
def g07(spark, sf_dir):
    made = stats.provenance_stats(derived(spark, sf_dir, PROVENANCE))
    return made.withColumns({f"avg_{o}": F.round(f"avg_{o}", 6) for o in ORIGINS})


@query("g07_low_confidence", f"with p as ({PROVENANCE}) select target, key, source, confidence from p where confidence < 0.5")
def g07_low(spark, sf_dir):
    return stats.low_confidence(derived(spark, sf_dir, PROVENANCE)).select("target", "key", "source", "confidence")


@query("g09_provenance_report", f"with p as ({PROVENANCE}) select source, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 6) as share, round(avg(confidence), 6) as confidence from p group by source")
def g09(spark, sf_dir):
    made = stats.provenance_report(derived(spark, sf_dir, PROVENANCE))
    return made.withColumns({"share": F.round("share", 6), "confidence": F.round("confidence", 6)})


_ENDS = ["", *IMPORT_EXTENSIONS, *[f"/index{e}" for e in IMPORT_EXTENSIONS]]
_RESOLVED = _BASE + f""", specs as (select distinct path as importer, trim(unnest(string_split(value, ','))) as spec from notes where name = 'imports'),
targets as (select importer, spec, case when starts_with(spec, './') then regexp_replace(importer, '/[^/]*$', '') || substr(spec, 2) when starts_with(spec, '../') then regexp_replace(importer, '/[^/]*/[^/]*$', '') || substr(spec, 3) end as target from specs),
ends as (select unnest([{', '.join(repr(e) for e in _ENDS)}]) as ending, unnest(range(0, {len(_ENDS)})) as rank),
hits as (select t.importer, t.spec, f.path, e.rank from targets t cross join ends e join code_files f on f.path = t.target || e.ending),
resolved as (select importer, spec, min_by(path, rank) as imported from hits group by importer, spec)"""


def _resolved(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    code = _files(spark, sf_dir)
    made = files.fold_files(notes.annotations(notes.lines(code)) if found is None else found)
    specs = made.select(F.col("path").alias("importer"), F.explode("imports").alias("spec"))
    return graph.resolve_imports(specs, code.select("path"))


@query("j05_import_resolution", _RESOLVED + " select importer, spec, imported from resolved")
def j05(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query("j06_imported_by", _RESOLVED + " select imported as path, array_to_string(list_sort(list(distinct importer)), ',') as imported_by from resolved group by imported")
def j06(spark, sf_dir):
    return graph.imported_by(_resolved(spark, sf_dir)).select("path", F.array_join("imported_by", ",").alias("imported_by"))


@query("g17_key_files", _RESOLVED + " select imported as path, count(distinct importer) as importers from resolved group by imported order by importers desc, path limit 10")
def g17(spark, sf_dir):
    return graph.most_imported(_resolved(spark, sf_dir))


@query("flagship_domain_locks", _BASE + f""", d as (select path, {_T} as domain from notes where name = 'domain' group by all), {_LOCKS}
select domain, count(*) as files, count(*) filter (where lock = 'frozen') as frozen, count(*) filter (where lock = 'restricted') as restricted from d join locks using (path) group by domain""")
def flagship(spark, sf_dir):
    return stats.domain_locks(files.fold_files(_notes(spark, sf_dir)))
