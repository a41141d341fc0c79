"""Reports that combine several tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotations as notes
from ..operators import attempts, contexts, files, graph, machines, primer, rewrite, stats, validation, variables
from ..schema import DIRECTIVES, LOCK_DIRECTIVES, MARKER
from .code import _BASE, _LEVEL, _LOCKS, _RESOLVED, _T, _case, _files, _kept_notes, _notes, _resolved
from .derived import CALL_EDGES, VARIABLES, derived
from .registry import query
from .state import _REFS, _variables


@query("g16_modify_context", _RESOLVED + f""", {_LOCKS}, c as (select path, {_LEVEL} as level from locks where lock is not null or hinted), i as (select imported as path, list_sort(list(distinct importer)) as importers from resolved group by imported),
d as (select path, min({_T}) as domain from notes where name = 'domain' group by path)
select f.path, array_to_string(coalesce(i.importers, []), ',') as importers, coalesce(len(i.importers), 0) as importer_count, c.level, d.domain from code_files f left join i using (path) left join c using (path) left join d using (path)""")
def g16_modify(spark, sf_dir):
    found = _kept_notes(spark, sf_dir)
    made = files.fold_files(found)
    rows = contexts.modify(made, graph.imported_by(_resolved(spark, sf_dir, found)), stats.lock_row(made))
    return rows.select("path", F.array_join("importers", ",").alias("importers"), "importer_count", "level", "domain")


@query("g16_explore_context", _RESOLVED + """, k as (select imported as path, count(distinct importer) as n from resolved group by imported order by n desc, path limit 10)
select (select count(*) from code_files) as files, (select count(*) from (select distinct path, symbol, opener_line from scoped where symbol is not null)) as symbols,
(select count(distinct value) from notes where name = 'domain') as domains, (select string_agg(path, ',' order by n desc, path) from k) as key_files""")
def g16_explore(spark, sf_dir):
    from ..functions.paths import language

    code = _files(spark, sf_dir)
    found = _kept_notes(spark, sf_dir)
    counted = code.select("path", language(F.col("path")).alias("language"), notes.line_count(F.col("content")).alias("lines"))
    made = files.fold_files(found).join(counted.hint("merge"), "path")
    whole = contexts.explore(made, files.fold_symbols(found), graph.most_imported(_resolved(spark, sf_dir, found)))
    return whole.select("files", "symbols", F.size("domains").cast("long").alias("domains"), F.array_join("key_files", ",").alias("key_files"))


@query("g10_symbol_report", f"""with e as ({CALL_EDGES}), s as (select distinct 'f' || o_orderkey as name from orders), i as (select callee as name, count(*) as callers from e group by callee), o as (select caller as name, count(distinct callee) as callees from e group by caller)
select s.name, coalesce(i.callers, 0) as callers, coalesce(o.callees, 0) as callees from s left join i using (name) left join o using (name)""")
def g10(spark, sf_dir):
    edges = derived(spark, sf_dir, CALL_EDGES)
    symbols = spark.sql("select distinct concat('f', cast(o_orderkey as varchar(40))) as name from orders")
    rows = contexts.symbol_report(symbols, graph.callers(edges), graph.callees(edges))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(c)
    return rows.select("name", size("callers"), size("callees"))


_DOCUMENTED = """select concat('p', cast(o_orderkey as varchar(40))) as path, concat('/** head */', chr(10), case when o_orderkey % 3 = 0 then concat('/**', chr(10), ' * Doc', chr(10), ' */', chr(10), '@dec') else concat('x = 1', chr(10), chr(10), '// note', chr(10)) end, chr(10), 'function f() {}') as content, o_orderkey from orders"""


@query("a04_doc_ranges", f"with d as ({_DOCUMENTED}) select path, 'f' as name, 6::bigint as line_start, 2::bigint as doc_start, 4::bigint as doc_end from d where o_orderkey % 3 = 0")
def a04(spark, sf_dir):
    rows = derived(spark, sf_dir, _DOCUMENTED)
    return notes.doc_ranges(notes.lines(rows), rows.select("path", F.lit("f").alias("name"), F.lit(6).cast("long").alias("line_start")))


_LEGACY = _BASE + f""", old as (select path, line_no, text, nullif(regexp_extract(text, '{MARKER}([\\w-]+)(?:\\s+(.+))?', 1), '') as name, nullif(trim(regexp_extract(text, '{MARKER}([\\w-]+)(?:\\s+(.+))?', 2)), '') as value from lines where contains(text, '{MARKER}') and not contains(text, ' - ')),
new as (select path, line_no, text || ' - ' || case when name = 'lock' then {_case(LOCK_DIRECTIVES, "coalesce(value, 'normal')")} else {_case(DIRECTIVES, "name")} end as rewritten from old),
ch as (select * from new where rewritten is not null)"""


@query("k06_migrated_files", _LEGACY + """
select l.path, string_agg(coalesce(c.rewritten, l.text), chr(10) order by l.line_no) as after from lines l left join ch c using (path, line_no) where l.path in (select path from ch) group by l.path""")
def k06(spark, sf_dir):
    return notes.migrated(_files(spark, sf_dir)).select("path", "after")


@query("k06_migration_diffs", _LEGACY + """, sh as (select l.path, l.line_no, l.text, c.rewritten from lines l left join ch c using (path, line_no) where exists (select 1 from ch x where x.path = l.path and x.line_no between l.line_no - 3 and l.line_no + 3)),
g as (select *, line_no - row_number() over (partition by path order by line_no) as hunk, line_no - row_number() over (partition by path, rewritten is null order by line_no) as run from sh),
a as (select path, hunk, line_no, text, rewritten, case when rewritten is null then line_no else min(line_no) over (partition by path, rewritten is null, run) end as island from g),
r as (select path, hunk, line_no, island, 0 as part, case when rewritten is null then ' ' else '-' end || text as t from a union all select path, hunk, line_no, island, 1, '+' || rewritten from a where rewritten is not null),
h as (select path, min(line_no) as first, '@@ -' || min(line_no) || ',' || count(distinct line_no) || ' +' || min(line_no) || ',' || count(distinct line_no) || ' @@' || chr(10) || string_agg(t, chr(10) order by island, part, line_no) as text from r group by path, hunk)
select path, '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || string_agg(text, chr(10) order by first) as diff from h group by path""")
def k06_diffs(spark, sf_dir):
    return rewrite.hunks(notes.migration_script(_files(spark, sf_dir)))


_KEPT = "select cast(page_id as varchar(40)) as path, html as content, md5(html) as hash, case when page_id % 3 = 0 then concat(html, 'x') else html end as now from pages where page_id % 7 <> 0"


@query("t02_checkpoint_restore", f"with k as ({_KEPT}) select path, content from k where cast(path as bigint) % 3 = 0 or cast(path as bigint) % 5 = 0")
def t02(spark, sf_dir):
    kept = derived(spark, sf_dir, _KEPT)
    current = kept.where("cast(path as bigint) % 5 <> 0").select("path", F.col("now").alias("content"))
    return attempts.restore_plan(kept.select("path", "content", "hash"), current).select("path", "content")


@query("t03_debug_sessions", """select user_id as session, count(*) as attempts, count(*) filter (where event_type = 'purchase') as kept, count(*) filter (where event_type = 'error') as reverted,
max_by(event_type, (ts, event_id)) as status from events group by user_id""")
def t03(spark, sf_dir):
    rows = derived(spark, sf_dir, "select user_id as session, case event_type when 'purchase' then 'success' when 'error' then 'failure' end as result, event_type as status, ts, event_id as seq from events")
    return attempts.debug_sessions(rows)


_MOVES = """select concat('a', cast(user_id as varchar(40))) as id, case when event_id % 17 = 0 then 'lost' else case event_type when 'click' then 'start' when 'view' then 'modify' when 'error' then 'fail' when 'purchase' then 'verify' else 'revert' end end as event, ts, event_id as seq from events"""


@query("t01_transitions", f"""with recursive e as (select *, row_number() over (partition by id order by ts, seq, event) as n from ({_MOVES})),
w as (select distinct id, 0::bigint as n, null::varchar as event, null::bigint as seq, 'absent' as before, 'absent' as after from e
union all select e.id, e.n, e.event, e.seq, w.after, case when e.event = 'start' then 'active' when e.event = 'fail' and w.after <> 'absent' then 'failed' when e.event in ('verify', 'revert') then 'absent' else w.after end from w join e on e.id = w.id and e.n = w.n + 1)
select id, event, seq, before, after, case when event = 'lost' then 'unknown' when before = 'absent' and event in ('modify', 'revert') then 'forbidden' when before = 'absent' and event in ('fail', 'verify') then 'ignored' else 'done' end as verdict from w where n > 0""")
def t01_moves(spark, sf_dir):
    return machines.run(derived(spark, sf_dir, _MOVES), attempts.ATTEMPT).drop("ts")


_TRIES = """select concat('s', cast(user_id % 20 as varchar(40)), '/', cast(user_id as varchar(40))) as id, case event_type when 'click' then 'add' when 'view' then 'partial' when 'error' then 'failure' when 'purchase' then 'success' else 'revert' end as event, ts, event_id as seq from events"""


@query("t03_session_tries", f"""with e as ({_TRIES}), a as (select id, min((ts, seq)) filter (where event = 'add') as added from e group by id),
t as (select id, added is not null as there, coalesce(bool_or(event = 'success') filter (where (ts, seq) > added), false) as won, coalesce(bool_or(event = 'revert') filter (where (ts, seq) > added), false) as gone from e join a using (id) group by id, added)
select split_part(id, '/', 1) as session, count(*) filter (where there) as attempts, count(*) filter (where won and not gone) as kept, count(*) filter (where gone) as reverted from t group by 1""")
def t03_tries(spark, sf_dir):
    return attempts.tries(derived(spark, sf_dir, _TRIES))


_ITEMS = """select case p_partkey % 3 when 0 then 'files' when 1 then 'hacks' else 'domains' end as source, concat('k', cast(p_partkey as varchar(40))) as key, case p_partkey % 4 when 0 then 'frozen' when 1 then 'restricted' else 'normal' end as level, p_partkey % 5 = 0 as expired, p_name as name from part"""


@query("r07_r08_rendered_sections", f"""with i as ({_ITEMS}), f as (select 's1' as id, *, row_number() over (order by key) as r from i where source = 'files' and level in ('frozen', 'restricted')
union all select 's2', *, row_number() over (order by key) from i where source = 'hacks' and not expired),
k as (select * from f where r <= case id when 's1' then 4 else 10 end)
select id, case id when 's1' then 'Protected:' || chr(10) else 'Hacks: ' end || case id when 's1' then string_agg('- ' || key || ' ' || level, chr(10) order by r) else string_agg('- ' || key || ' ' || name, '; ' order by r) end as text from k group by id
union all select 's3', 'none'""")
def r07(spark, sf_dir):
    items = derived(spark, sf_dir, _ITEMS).withColumn("fields", F.create_map(F.lit("key"), "key", F.lit("level"), "level", F.lit("name"), "name"))
    sections = spark.createDataFrame(
        [
            ("s1", "files", ["frozen", "restricted"], None, 4, "Protected:\n", "- {{key}} {{level}}{{other}}", "\n", "", ""),
            ("s2", "hacks", None, False, None, "Hacks: ", "- {{key}} {{name}}", "; ", "", ""), ("s3", "nothing", None, None, None, "", "", "", "", "none"),
        ],
        "id string, source string, levels array<string>, wanted_expired boolean, max_items int, header string, item string, separator string, footer string, empty string",
    )
    return primer.render_sections(primer.dynamic_rows(items, sections), sections)


@query("v05_chains", f"""with recursive v as ({VARIABLES}), r as ({_REFS}), e as (select name as src, unnest(refs) as dst from r),
walk as (select src as node, dst as reached, 1 as depth from e union select w.node, e.dst, w.depth + 1 from walk w join e on e.src = w.reached where w.depth < 16),
m as (select node, reached, min(depth) as depth from walk group by all)
select node as name, string_agg(reached, ',' order by depth, reached) as chain, count(*) as reached, cast(max(depth) as bigint) as depth, bool_or(node = reached) as has_cycle from m group by node""")
def v05_chains(spark, sf_dir):
    return variables.chains(_variables(spark, sf_dir)).withColumn("chain", F.array_join("chain", ","))


_EDGES = f"with recursive v as ({VARIABLES}), r as ({_REFS}), e as (select name as src, unnest(refs) as dst, unnest(range(len(refs))) as pos from r)"


@query("c03_cycle_paths", f"""{_EDGES},
walk as (select src as node, dst as reached, 1 as depth from e union select w.node, e.dst, w.depth + 1 from walk w join e on e.src = w.reached where w.depth < 16),
mutual as (select distinct a.node, a.reached from walk a join walk b on a.node = b.reached and a.reached = b.node),
least as (select node, min(reached) as component from mutual group by node),
way as (select component, component as node, [component] as path from least where node = component
union all select way.component, e.dst, list_append(path, e.dst) from way join e on e.src = way.node join least on least.node = e.dst and least.component = way.component where not list_contains(path, e.dst)),
closed as (select component, list_append(path, component) as path from way join e on e.src = way.node and e.dst = way.component)
select component, cast(min(len(path)) - 1 as bigint) as length, array_to_string(arg_min(path, (len(path), path)), ' -> ') as path from closed group by component""")
def c03_cycle_paths(spark, sf_dir):
    return graph.cycle_paths(variables.edges(_variables(spark, sf_dir))).withColumn("path", F.array_join("path", " -> "))


def _inherited(repeats):
    return f"""{_EDGES},
w as (select name as root, name as node, cast([] as bigint[]) as key, [name] as way from r
union all select w.root, e.dst, list_append(key, pos), list_append(way, e.dst) from w join e on e.src = w.node where not list_contains(way, e.dst)),
k as (select root, node, min(key) as key, arg_min(way, key) as way from w group by all),
s as (select k.root, min(list_append(k.key, e.pos)) as stop from k join e on e.src = k.node {repeats} group by k.root)
select k.root as name, string_agg(k.node, ',' order by key) as chain, count(*) - 1 as depth, bool_or(s.stop is not null) as has_cycle from k left join s on s.root = k.root where s.stop is null or k.key < s.stop group by k.root"""


@query("v05_inheritance", _inherited("where list_contains(k.way, e.dst)"))
def v05_inheritance(spark, sf_dir):
    return variables.inheritance(_variables(spark, sf_dir)).withColumn("chain", F.array_join("chain", ","))


@query("v05_inheritance_compatible", _inherited("join k x on x.root = k.root and x.node = e.dst where list_append(k.key, e.pos) != x.key"))
def v05_inheritance_compatible(spark, sf_dir):
    return variables.inheritance(_variables(spark, sf_dir), by_path=False).withColumn("chain", F.array_join("chain", ","))


@query("c02_attempt_violations", """with a as (select event_id, case event_type when 'click' then 'active' when 'view' then 'odd' else 'failed' end as status, event_id % 9 as started_at, event_id % 7 as ended_at, case when event_id % 4 = 0 then 'xyz' else md5(event_type) end as hash from events)
select event_id as key, 'unknown status' as message from a where status = 'odd' union all select event_id, 'ended before it started' from a where ended_at < started_at union all select event_id, 'bad hash' from a where hash = 'xyz'""")
def c02(spark, sf_dir):
    rows = derived(spark, sf_dir, "select event_id, case event_type when 'click' then 'active' when 'view' then 'odd' else 'failed' end as status, event_id % 9 as started_at, event_id % 7 as ended_at, case when event_id % 4 = 0 then 'xyz' else md5(cast(event_type as binary)) end as hash from events")
    return validation.violations(rows, "attempts", "event_id")
