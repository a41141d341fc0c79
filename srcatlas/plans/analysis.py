"""History, conventions, suggestions, constraints and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.conditions import confidence
from ..operators import constraints, conventions, history, lookups, suggestions
from ..schema import LOCK_LEVELS, MARKER
from .derived import BLAME, COMMITS, PROVENANCE, RANGES, derived
from .registry import query

AS_OF = "2024-01-01 00:00:00"


@query("j03_g18_history", f"""with c as ({COMMITS}) select path, count(*) as commits, array_to_string(list_sort(list(distinct author)), ',') as authors, cast(min(ts) as varchar) as first_ts, cast(max(ts) as varchar) as last_ts,
max_by(commit_id, (ts, commit_id)) as last_commit, cast(sum(added) as bigint) as added, cast(sum(removed) as bigint) as removed from c group by path""")
def g18(spark, sf_dir):
    made = history.summary(derived(spark, sf_dir, COMMITS))
    return made.select("path", "commits", F.array_join("authors", ",").alias("authors"), F.col("first_ts").cast("string").alias("first_ts"), F.col("last_ts").cast("string").alias("last_ts"), "last_commit", "added", "removed")


@query("s11_newest_commits", f"with c as ({COMMITS}), r as (select *, row_number() over (partition by path order by ts desc, commit_id) as k from c) select path, commit_id, author from r where k <= 3")
def s11(spark, sf_dir):
    return history.newest(derived(spark, sf_dir, COMMITS), 3).select("path", "commit_id", "author")


_AGE = "greatest(cast(floor((epoch(timestamp '" + AS_OF + "') - epoch(date_trunc('second', {c}))) / 86400) as bigint), 0)"


@query("j04_g19_symbol_blame", f"""with b as ({BLAME}), r as ({RANGES}) select r.path, r.name, count(distinct b.line_no) as lines, array_to_string(list_sort(list(distinct b.author)), ',') as authors,
{_AGE.format(c='max(b.ts)')} as newest_days, {_AGE.format(c='min(b.ts)')} as oldest_days from r join b on r.path = b.path and b.line_no between r.line_start and r.line_end group by r.path, r.name""")
def j04(spark, sf_dir):
    blame = derived(spark, sf_dir, BLAME)
    made = history.symbol_blame(spark.sql(RANGES), blame, AS_OF)
    return made.withColumn("authors", F.array_join("authors", ","))


_DIRS = "case c_custkey % 6 when 0 then 'src/auth' when 1 then 'src/api/routes' when 2 then 'lib/db' when 3 then 'tests/unit' when 4 then 'app/components' else 'src/user-service' end"
_PAGES = f"""select case when c_custkey % 6 = 1 and c_custkey % 30 <> 1 then concat({_DIRS}, '/f', cast(c_custkey as varchar(40)), '.routes.ts')
when c_custkey % 6 = 4 then concat({_DIRS}, '/c', cast(c_custkey as varchar(40)), '.component.tsx')
when c_custkey % 6 = 3 then concat({_DIRS}, '/t', cast(c_custkey as varchar(40)), '_test.py')
else concat({_DIRS}, '/m', cast(c_custkey as varchar(40)), case c_custkey % 4 when 0 then '.ts' when 1 then '.go' when 2 then '.rs' else '.py' end) end as path, cast(c_custkey % 300 as bigint) as lines from customer"""
_SUFFIX = "case " + " ".join(f"when ends_with(name, '{s}') then '{s}'" for s in conventions.SUFFIXES) + r" else regexp_extract(name, '(\.[^.]*)$', 1) end"
_PARENT = "regexp_extract(path, '^(.*)/[^/]*$', 1)"


@query("g11_naming_conventions", f"""with f as ({_PAGES}), n as (select {_PARENT} as folder, regexp_extract(path, '([^/]*)$', 1) as name from f), s as (select folder, name, {_SUFFIX} as suffix from n),
c as (select folder, suffix, count(*) as n, list_sort(list(distinct name)) as names from s group by all), w as (select folder, sum(n) as files, list(suffix) as used, max(struct_pack(n := n, s := suffix, e := names)) as top from c group by folder)
select folder, '*' || top.s as pattern, cast(round(top.n / files, 6) as double) as confidence, array_to_string(top.e[1:5], ',') as examples,
coalesce((select string_agg('*' || b, ',' order by b) from (values {', '.join(f"('{a}', '{b}')" for a, b in conventions.SIMILAR)}) as p(a, b) where a = top.s and not list_contains(used, b)), '') as avoid
from w where files >= 3 and top.n / files >= 0.7""")
def g11(spark, sf_dir):
    made = conventions.naming(derived(spark, sf_dir, _PAGES))
    return made.select("folder", "pattern", F.round("confidence", 6).alias("confidence"), F.array_join("examples", ",").alias("examples"), F.array_join(F.array_sort("avoid"), ",").alias("avoid"))


@query("g12_import_style", f"with f as ({_PAGES}) select 'esm' as module_system, 'relative' as path_style, false as index_exports where exists (select 1 from f where regexp_matches(path, '\\.(ts|tsx|js|jsx)$'))")
def g12(spark, sf_dir):
    found = derived(spark, sf_dir, _PAGES)
    return conventions.import_style(found.select("path", paths.language(F.col("path")).alias("language")))


_LANG = "case regexp_extract(path, '\\.([a-z]+)$', 1) when 'ts' then 'typescript' when 'tsx' then 'typescript' when 'go' then 'go' when 'rs' then 'rust' when 'py' then 'python' end"


@query("g13_folder_language", f"""with f as ({_PAGES}), c as (select {_PARENT} as folder, {_LANG} as language, count(*) as n from f group by all)
select folder, min_by(language, (-n, language)) as language from c group by folder""")
def g13(spark, sf_dir):
    found = derived(spark, sf_dir, _PAGES)
    return conventions.folder_language(found.select("path", paths.language(F.col("path")).alias("language")))


@query("g14_convention_for_path", f"""with f as ({_PAGES}), c(folder, pattern) as (values ('src', '*.ts'), ('src/api', '*.api.ts'), ('src/api/routes', '*.routes.ts'), ('lib', '*.go'))
select path, max_by(folder, len(folder)) as folder, max_by(pattern, len(folder)) as pattern from f join c on starts_with(path, folder || '/') group by path""")
def g14(spark, sf_dir):
    found = derived(spark, sf_dir, _PAGES)
    known = spark.sql("select * from values ('src', '*.ts'), ('src/api', '*.api.ts'), ('src/api/routes', '*.routes.ts'), ('lib', '*.go') as c(folder, pattern)")
    return conventions.convention_for(found, known)


@query("g15_similar_files", f"""with f as ({_PAGES}), l as (select {_PARENT} as folder, list_sort(list(distinct path)) as paths from f group by all)
select path, array_to_string(list_filter(paths, lambda p : p <> path)[1:5], ',') as "similar" from f join l on l.folder = {_PARENT.replace('path', 'f.path')}""")
def g15(spark, sf_dir):
    return conventions.similar_files(derived(spark, sf_dir, _PAGES)).withColumn("similar", F.array_join("similar", ","))


@query("g24_folder_tree", f"""with f as ({_PAGES}), p as (select path, lines, string_split(path, '/') as parts from f), s as (select *, unnest(range(0, len(parts))) as level from p)
select case when level = 0 then '.' else array_to_string(parts[1:level], '/') end as folder, cast(level as bigint) as level, count(*) filter (where level = len(parts) - 1) as files, count(*) as files_below, cast(sum(lines) as bigint) as lines_below from s where level <= 3 group by all""")
def g24(spark, sf_dir):
    return conventions.tree(derived(spark, sf_dir, _PAGES))


_SYMBOLS = """select concat(case p_partkey % 8 when 0 then 'getUserToken' when 1 then 'saveOrder' when 2 then 'mock_list' when 3 then 'RouteHandler' when 4 then 'price_service' when 5 then 'GuardFilter' when 6 then 'plainThing' else 'tempCache' end, cast(p_partkey as varchar(40))) as target,
cast(p_size as bigint) as line, case p_partkey % 5 when 0 then 'private' when 1 then 'protected' when 2 then 'internal' when 3 then 'crate' else 'public' end as visibility, p_partkey % 2 = 0 as exported,
case p_partkey % 4 when 0 then 'function' when 1 then 'class' when 2 then 'interface' else 'method' end as kind from part"""


def _name_rules() -> str:
    parts = []
    for names, items in suggestions.NAMES:
        test = f"regexp_matches(lower(target), '{'|'.join(names)}')"
        parts += [f"select target, line, '{k}' as kind, '{v}' as value, {c}::double as confidence from s where {test}" for k, v, c in items]
    return " union all ".join(parts)


@query("a06_name_heuristics", f"with s as ({_SYMBOLS}) {_name_rules()}")
def a06(spark, sf_dir):
    return suggestions.by_name(derived(spark, sf_dir, _SYMBOLS)).select("target", "line", "kind", "value", "confidence")


_VERB = "case lower(w[1]) " + " ".join(f"when '{k}' then '{v}'" for k, v in suggestions.VERBS.items())
_ENDED = "case when regexp_matches(lower(w[1]), '(x|ch|sh|ss|us|is)$') then lower(w[1]) || 'es' when ends_with(lower(w[1]), 's') then lower(w[1]) when regexp_matches(lower(w[1]), '[^aeiou]y$') then regexp_replace(lower(w[1]), 'y$', '') || 'ies' else lower(w[1]) || 's' end"
_THIRD = f"{_VERB} else upper(({_ENDED})[1]) || substr({_ENDED}, 2) end"


@query("a07_symbol_summary", f"""with s as ({_SYMBOLS}), t as (select target, kind, list_filter(string_split(replace(regexp_replace(regexp_replace(target, '([A-Z])', ' \\1', 'g'), '^ ', ''), '_', ' '), ' '), lambda x : x <> '') as w from s),
m as (select target, kind, case when kind in ('function', 'method') then trim({_THIRD} || ' ' || array_to_string(list_transform(w[2:], lambda x : lower(x)), ' '))
when kind = 'class' then upper(w[1][1]) || substr(array_to_string(list_transform(w, lambda x : lower(x)), ' '), 2) else array_to_string(w, '') || ' ' || kind end as made from t)
select target, kind, case when len(made) < 5 or regexp_matches(made, '(eses|sses)(\\s|$)|  ') then upper(target[1]) || substr(lower(target), 2) || ' ' || kind else made end as summary from m""")
def a07(spark, sf_dir):
    return derived(spark, sf_dir, _SYMBOLS).select("target", "kind", suggestions.summary(F.col("target"), F.col("kind")).alias("summary"))


def _path_case(table: dict[str, str]) -> str:
    return "case " + " ".join(f"when contains(part, '{k}') then '{v}'" for k, v in table.items()) + " end"


@query("a08_path_heuristics", f"""with f as ({_PAGES}), p as (select path, lower(unnest(string_split(path, '/'))) as part from f),
u as (select path, 'domain' as kind, {_path_case(suggestions.DOMAINS)} as value, 0.7::double as confidence from p union all select path, 'layer', {_path_case(suggestions.LAYERS)}, 0.6::double from p)
select distinct path as target, kind, value, confidence from u where value is not null""")
def a08(spark, sf_dir):
    found = derived(spark, sf_dir, _PAGES).select("path", F.col("path").alias("target"), F.lit(1).cast("long").alias("line"))
    return suggestions.by_path(found).select("target", "kind", "value", "confidence")


@query("a08_module_names", f"""with f as ({_PAGES}) select path, upper(s[1]) || substr(s, 2) as module from (select path, lower(replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', ''), '_', ' ')) as s from f)""")
def a08_module(spark, sf_dir):
    return derived(spark, sf_dir, _PAGES).select("path", suggestions.module_name(F.col("path")).alias("module"))


_VIS = " union all ".join(
    f"select target, line, '{k}' as kind, '{v}' as value, {c}::double as confidence from s where visibility = '{vis}'" for vis, items in suggestions.VISIBILITY.items() for k, v, c in items
)


@query("a09_visibility_heuristics", f"with s as ({_SYMBOLS}) {_VIS} union all select target, line, 'lock', 'normal', 0.5::double from s where visibility = 'public' and exported")
def a09(spark, sf_dir):
    return suggestions.by_visibility(derived(spark, sf_dir, _SYMBOLS)).select("target", "line", "kind", "value", "confidence")


@query("a10_history_heuristics", f"""with c as ({COMMITS}), h as (select path, count(*) as n, count(distinct author) as a, min(author) as who, {_AGE.format(c='max(ts)')} as d, cast(sum(added) + sum(removed) as bigint) as x from c group by path)
select path as target, 'ai-hint' as kind, 'High-churn file: ' || n || ' commits by ' || a || ' contributors' as value from h where n >= 20
union all select path, 'ai-hint', 'Single author: ' || who || '. Consider code review for bus factor.' from h where a < 2 and n > 5
union all select path, 'stability', 'stable' from h where d >= 180 union all select path, 'ai-hint', 'Stable code: unchanged for ' || d || ' days' from h where d >= 180
union all select path, 'lock', 'normal' from h where x > 500 and n > 10 union all select path, 'ai-hint', 'Volatile code: ' || x || ' lines changed across ' || n || ' commits' from h where x > 500 and n > 10""")
def a10(spark, sf_dir):
    made = history.summary(derived(spark, sf_dir, COMMITS))
    facts = made.select(F.col("path").alias("target"), F.lit(1).cast("long").alias("line"), "commits", "authors", history.age_days(F.col("last_ts"), AS_OF).alias("days"), "added", "removed")
    return suggestions.by_history(facts).select("target", "kind", "value")


_SUGGESTED = """select concat('s', cast(l_orderkey % 400 as varchar(40))) as target, cast(l_orderkey % 400 as bigint) as line, case l_linenumber % 4 when 0 then 'summary' when 1 then 'lock' when 2 then 'domain' else 'stability' end as kind,
concat('v', cast(l_partkey as varchar(40))) as value, case l_suppkey % 3 when 0 then 'explicit' when 1 then 'converted' else 'heuristic' end as source, l_discount * 10 as confidence,
cast(l_orderkey * 100 + l_linenumber as bigint) as ord from lineitem"""


@query("g22_priority_dedup", f"""with s as ({_SUGGESTED}), r as (select *, row_number() over (partition by target, kind order by case source when 'explicit' then 0 when 'converted' then 1 else 2 end, ord, value) as k
from s where kind in ('module', 'summary', 'domain', 'lock', 'layer', 'deprecated')) select target, line, kind, value, source from r where k = 1""")
def g22(spark, sf_dir):
    return suggestions.priority(derived(spark, sf_dir, _SUGGESTED), "standard").select("target", "line", "kind", "value", "source")


@query("g21_suggestion_report", f"""with s as ({_SUGGESTED}) select coalesce('kind:' || kind, 'source:' || source, 'all') as label, count(*) as n, round(avg(confidence), 6) as confidence, count(distinct target) as targets
from s group by grouping sets ((kind), (source), ())""")
def g21(spark, sf_dir):
    return suggestions.report(derived(spark, sf_dir, _SUGGESTED)).withColumn("confidence", F.round("confidence", 6))


@query("f14_suggestion_filter", f"with s as ({_SUGGESTED}) select target, kind, value from s where confidence >= 0.5 and kind in ('module', 'summary') and not contains(target, '/')")
def f14(spark, sf_dir):
    rows = derived(spark, sf_dir, _SUGGESTED)
    keep = F.col("kind").isin(*suggestions.levels_include("minimal")) & confidence(">=0.5", F.col("confidence"))
    return rows.where(keep & ~F.col("target").contains("/")).select("target", "kind", "value")


_TARGETS = "select concat('t', cast(o_orderkey as varchar(40))) as target, cast(o_orderkey % 50 as bigint) as line, o_orderkey % 3 = 0 as is_file, o_orderkey % 2 = 0 as exported from orders"
_EXISTING = "select concat('t', cast(l_orderkey as varchar(40))) as target, case l_linenumber % 5 when 0 then 'module' when 1 then 'summary' when 2 then 'domain' when 3 then 'lock' else 'layer' end as kind from lineitem"


@query("j10_a03_gaps", f"""with t as ({_TARGETS}), e as (select distinct * from ({_EXISTING})), w as (select target, line, unnest(case when is_file then ['module', 'summary', 'domain'] else ['summary', 'domain', 'lock', 'layer', 'deprecated'] end) as kind from t)
select w.target, w.line, w.kind from w anti join e on e.target = w.target and e.kind = w.kind""")
def j10(spark, sf_dir):
    targets = derived(spark, sf_dir, _TARGETS)
    return suggestions.gaps(targets, spark.sql(_EXISTING)).select("target", "line", "kind")


_NOTED = "select concat('p', cast(l_orderkey % 300 as varchar(40))) as path, cast((l_orderkey * 7 + l_partkey) % 400 as bigint) as line_no, 'summary' as kind, concat('v', cast(l_partkey as varchar(40))) as value from lineitem"
_STARTS = "select concat('p', cast(o_orderkey % 300 as varchar(40))) as path, concat('s', cast(o_orderkey as varchar(40))) as name, cast((o_orderkey * 13) % 400 as bigint) as line_start from orders where o_orderkey % 3 = 0"


@query("j11_next_symbol", f"""with n as ({_NOTED}), s as ({_STARTS}) select n.path, n.line_no, n.value, (select min_by(name, (line_start, name)) from s where s.path = n.path and s.line_start > n.line_no and s.line_start <= n.line_no + 20) as symbol from n""")
def j11(spark, sf_dir):
    noted = derived(spark, sf_dir, _NOTED)
    return suggestions.attach(noted, spark.sql(_STARTS)).select("path", "line_no", "value", "symbol")


_COUNTS = "select concat('c', cast(o_custkey as varchar(40))) as path, count(*) filter (where o_orderstatus = 'F') as existing, count(*) filter (where o_orderstatus = 'O') as missing from orders group by o_custkey"


@query("g20_coverage", f"with c as ({_COUNTS}) select path, existing, missing, case when existing + missing = 0 then 100.0::double else 100.0::double * existing / (existing + missing) end as coverage from c")
def g20(spark, sf_dir):
    return suggestions.coverage(derived(spark, sf_dir, _COUNTS))


@query("a17_coverage_gate", f"with c as ({_COUNTS}) select cast(sum(existing) as bigint) as existing, cast(sum(missing) as bigint) as missing, 100.0::double * sum(existing) / (sum(existing) + sum(missing)) as coverage, 100.0 * sum(existing) / (sum(existing) + sum(missing)) >= 80 as passed from c")
def a17(spark, sf_dir):
    return suggestions.total_coverage(derived(spark, sf_dir, _COUNTS)).withColumn("passed", F.col("coverage") >= 80.0)


@query("a12_rendered", f"""with s as ({_SUGGESTED}) select target, ord, '{MARKER}' || kind || ' ' || case when kind = 'summary' then '"' || value || '"' else value end as text, array_to_string(list_filter([
'{MARKER}source ' || source, case when confidence < 1 then '{MARKER}source-confidence ' || printf('%.2f', confidence) end, '{MARKER}source-reviewed false'], lambda x : x is not null), '|') as about from s""")
def a12(spark, sf_dir):
    rows = derived(spark, sf_dir, _SUGGESTED)
    lines = suggestions.with_source_lines(F.col("kind"), F.col("value"), F.col("source"), F.col("confidence"), F.lit(None).cast("string"))
    return rows.select("target", "ord", F.get(lines, F.lit(0)).alias("text"), F.array_join(F.slice(lines, 2, 9), "|").alias("about"))


@query("f13_eligible_symbols", f"""with s as ({_SYMBOLS}) select target, visibility, kind from s where visibility = 'public' or (visibility <> 'private' and kind in ('class', 'interface'))""")
def f13(spark, sf_dir):
    rows = derived(spark, sf_dir, _SYMBOLS)
    return rows.where(suggestions.eligible(F.col("visibility"), F.col("kind"))).select("target", "visibility", "kind")


_RULED = """select concat('c', cast(o_orderkey as varchar(40))) as path, case o_orderkey % 9 when 0 then 'frozen' when 1 then 'restricted' when 2 then 'approval-required' when 3 then 'tests-required' when 4 then 'docs-required' when 5 then 'review-required' when 6 then 'experimental' else 'normal' end as level,
case o_orderkey % 4 when 0 then 'rename' when 1 then 'edit' else 'delete' end as operation, o_orderkey % 3 = 0 as approval, o_orderkey % 5 = 0 as tests, o_orderkey % 7 = 0 as docs, case when o_orderkey % 4 = 1 then cast(o_orderkey % 90 as bigint) end as most from orders"""


@query("f16_permission", f"""with r as ({_RULED}) select path, case when level = 'frozen' then 'denied' when level = 'restricted' and operation not in ('rename', 'edit') then 'denied' when level in ('restricted', 'approval-required') then 'approval' else 'allowed' end as answer from r""")
def f16(spark, sf_dir):
    rows = derived(spark, sf_dir, _RULED)
    return rows.select("path", constraints.permission(F.col("level"), F.col("operation"), F.array(F.lit("rename"), F.lit("edit"))).alias("answer"))


@query("f17_requirements", f"""with r as ({_RULED}) select path, array_to_string(list_sort(list_filter([case when approval then 'approval' end, case when tests then 'tests' end, case when docs then 'docs' end, 'max-lines:' || most], lambda x : x is not null)), ',') as needs from r""")
def f17(spark, sf_dir):
    rows = derived(spark, sf_dir, _RULED)
    made = constraints.requirements(F.col("approval"), F.col("tests"), F.col("docs"), F.col("most"), F.lit(False))
    return rows.select("path", F.array_join(made, ",").alias("needs"))


@query("f18_overlay", f"""with r as ({_RULED}), up as (select path, 'normal' as level, 'up' as reason from r where path like '%1') select r.path, coalesce(case when approval then r.level end, up.level) as level, up.reason as reason,
case when up.path is null then 'own' else 'base,own' end as refs from r left join up using (path)""")
def f18(spark, sf_dir):
    rows = derived(spark, sf_dir, _RULED)
    none = F.lit(None).cast("string")
    child = rows.select("path", F.when(F.col("approval"), F.col("level")).alias("level"), none.alias("reason"), F.array(F.lit("own")).alias("refs"))
    up = rows.where("path like '%1'").select("path", F.lit("normal").alias("level"), F.lit("up").alias("reason"), F.array(F.lit("base")).alias("refs"))
    return constraints.overlay(child, up, "path", ["level", "reason"], ["refs"]).withColumn("refs", F.array_join("refs", ","))


_RANKED = "case level " + " ".join(f"when '{x}' then {i}" for i, x in enumerate(LOCK_LEVELS)) + " end"


@query("f20_check_report", f"""with r as ({_RULED}), k as (select *, row_number() over (partition by level order by path) as k, count(*) over (partition by level) as n from r)
select cast({_RANKED} as bigint) as rank, level, k as at, path, greatest(n - 10, 0) as more from k where k <= 10""")
def f20(spark, sf_dir):
    return constraints.check_report(derived(spark, sf_dir, _RULED))


@query("j08_files_with_constraints", f"""with r as ({_RULED}), f as (select './c' || cast(o_orderkey * 2 as varchar) as path from orders) select f.path, r.level from f left join r on r.path = substr(f.path, 3)""")
def j08(spark, sf_dir):
    rows = derived(spark, sf_dir, _RULED)
    found = spark.sql("select concat('./c', cast(o_orderkey * 2 as varchar(40))) as path from orders")
    return lookups.with_constraints(found, rows.select("path", "level"))


@query("f02_file_lookup", "with f as (select 'src/a/c' || cast(c_custkey as varchar) as path, c_acctbal from customer) select path, c_acctbal from f where path = 'src/a/c7'")
def f02(spark, sf_dir):
    rows = derived(spark, sf_dir, "select concat('src/a/c', cast(c_custkey as varchar(40))) as path, c_acctbal from customer")
    return lookups.file(rows, "./src/b/../a//c7")


@query("f03_normalized_paths", "select 'src/x' || cast(s_suppkey as varchar) || '/' || replace(s_name, '#', '') as path from supplier")
def f03(spark, sf_dir):
    rows = derived(spark, sf_dir, "select concat('.\\\\src/y/..//x', cast(s_suppkey as varchar(40)), '/./', replace(s_name, '#', '')) as path from supplier")
    return rows.select(paths.normalize(F.col("path")).alias("path"))


@query("f07_search_symbols", f"with s as ({_SYMBOLS}) select target as name, line from s where contains(lower(target), 'token1')")
def f07(spark, sf_dir):
    return lookups.search(derived(spark, sf_dir, _SYMBOLS).withColumnRenamed("target", "name"), "Token1").select("name", "line")


@query("f08_confidence_filter", f"with p as ({PROVENANCE}) select target, confidence from p where confidence >= 0.9 union all select target, confidence from p where abs(confidence - 0.5) < 0.001")
def f08(spark, sf_dir):
    rows = derived(spark, sf_dir, PROVENANCE)
    return rows.where(confidence(" >=0.9 ", F.col("confidence")) | confidence("=0.5", F.col("confidence"))).select("target", "confidence")


@query("f09_g26_review_queue", f"with p as ({PROVENANCE}) select target, key, source, coalesce(confidence, 1.0) as confidence from p where not reviewed and needs_review and source = 'heuristic' and (confidence is null or confidence < 0.7)")
def g26(spark, sf_dir):
    found = lookups.review_queue(derived(spark, sf_dir, PROVENANCE), "heuristic", "<0.7")
    return found.select("target", "key", "source", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


@query("g27_g08_mark_reviewed", f"""with p as ({PROVENANCE}), m as (select source, case when source = 'refined' then true else reviewed end as reviewed, case when source = 'refined' and not reviewed then false else needs_review end as needs_review from p)
select source, count(*) filter (where reviewed) as reviewed, count(*) filter (where needs_review) as needs_review from m group by source""")
def g27(spark, sf_dir):
    rows = lookups.mark_reviewed(derived(spark, sf_dir, PROVENANCE), F.col("source") == "refined")
    return rows.groupBy("source").agg(F.count_if("reviewed").alias("reviewed"), F.count_if("needs_review").alias("needs_review"))


@query("v06_token_estimates", "select doc_id, cast(ceil(strlen(text) / 4.0) as bigint) as tokens, case when length(text) > 100 then substr(text, 1, 97) || '...' else text end as short from documents")
def v06(spark, sf_dir):
    rows = derived(spark, sf_dir, "select doc_id, text from documents")
    return rows.select("doc_id", text.tokens(F.col("text")).alias("tokens"), text.truncated(F.col("text"), 100).alias("short"))


@query("f22_test_paths", f"with f as ({_PAGES}) select path from f where regexp_matches('/' || lower(path), '/(test|tests|__tests__|spec|e2e)/|\\.(test|spec)\\.|_(test|spec)\\.')")
def f22(spark, sf_dir):
    rows = derived(spark, sf_dir, _PAGES)
    return rows.where(paths.is_test(F.concat(F.lit("/"), "path"))).select("path")
