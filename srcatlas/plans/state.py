"""Variables, sections, documentation bridge, attempts and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import docs
from ..operators import attempts, bridge, graph, primer, stats, validation, variables
from ..operators import files as code_files
from ..schema import PRECEDENCES
from .code import _BASE, _T, _notes
from .derived import VARIABLES, derived
from .registry import query

_REFS = """select id, name, type, value, description, list_filter([case when id < 60 then 'V' || (id * 2 + 1) end, case when id < 60 then 'V' || (id * 2 + 2) end, case when id = 100 then 'V0' end], lambda x : x is not null) as refs from v"""


def _variables(spark, sf_dir):
    rows = derived(spark, sf_dir, VARIABLES)
    ref = lambda n: F.concat(F.lit("V"), (F.col("id") * 2 + n).cast("string"))
    refs = F.array_compact(F.array(F.when(F.col("id") < 60, ref(1)), F.when(F.col("id") < 60, ref(2)), F.when(F.col("id") == 100, F.lit("V0"))))
    return rows.withColumn("refs", refs)


@query("v05_chain_reach", f"""with recursive v as ({VARIABLES}), r as ({_REFS}), e as (select name as src, unnest(refs) as dst from r),
walk as (select src as node, dst as reached, 1 as depth from e union select w.node, e.dst, w.depth + 1 from walk w join e on e.src = w.reached where w.depth < 16)
select node, reached, cast(min(depth) as bigint) as depth from walk group by all""")
def v05(spark, sf_dir):
    return graph.reach(variables.edges(_variables(spark, sf_dir)))


@query("c03_cycles", f"""with recursive v as ({VARIABLES}), r as ({_REFS}), e as (select name as src, unnest(refs) as dst from r),
walk as (select src as node, dst as reached, 1 as depth from e union select w.node, e.dst, w.depth + 1 from walk w join e on e.src = w.reached where w.depth < 16)
select node, cast(min(depth) as bigint) as length from walk where node = reached group by node""")
def c03(spark, sf_dir):
    return graph.cycles(variables.edges(_variables(spark, sf_dir)))


_TEXTS = "select cast(conv_id * 100 + turn as bigint) as id, concat('see $V', cast(conv_id % 40 as varchar(40)), case turn % 3 when 0 then '.value' when 1 then '.type' else '' end, ' and $X', cast(turn as varchar(40)), ' in ', role) as text from conversations"


@query("v02_references", f"""with t as ({_TEXTS}), m as (select id, regexp_extract_all(text, '\\$([A-Z][A-Z0-9_]+)', 1) as n, regexp_extract_all(text, '\\$([A-Z][A-Z0-9_]+)(?:\\.(\\w+))?', 2) as f from t),
u as (select id, unnest(n) as name, nullif(unnest(f), '') as modifier, cast(unnest(range(0, len(n))) as bigint) as ord from m) select id, ord, name, modifier from u""")
def v02(spark, sf_dir):
    return variables.references(derived(spark, sf_dir, _TEXTS))


@query("v04_expand_texts", f"""with v as ({VARIABLES}), t as ({_TEXTS}), p as (select id, text, regexp_extract(text, '\\$(V[0-9]+)', 1) as name, nullif(regexp_extract(text, '\\$V[0-9]+\\.(\\w+)', 1), '') as modifier from t)
select p.id, case when v.name is null then text else replace(text, '$' || p.name || coalesce('.' || modifier, ''), case modifier when 'value' then v.value when 'type' then v.type else v.description end) end as expanded from p left join v on v.name = p.name""")
def v04(spark, sf_dir):
    found = variables.expand_texts(derived(spark, sf_dir, _TEXTS), derived(spark, sf_dir, VARIABLES), "summary")
    return found.select("id", "expanded")


_NESTED = """select concat('V', cast(p_partkey as varchar(40))) as name, case when p_partkey % 20 = 19 then concat('end', cast(p_partkey as varchar(40))) when p_partkey % 20 = 7 then concat('<$V', cast(p_partkey as varchar(40)), '>')
else concat('a', cast(p_partkey as varchar(40)), '-$V', cast(p_partkey + 1 as varchar(40)), '.') end as value from part"""


@query("v03_expand_values", f"""with recursive v as ({_NESTED}), w as (select name, value as text, [name] as way, 0 as depth from v
union all select w.name, replace(w.text, '$' || x.name, case when list_contains(w.way, x.name) then '[CYCLE:~' || x.name || ']' else x.value end), list_append(w.way, x.name), w.depth + 1
from w join v x on x.name = regexp_extract(w.text, '\\$(V[0-9]+)', 1) where w.depth < 4)
select name, replace(max_by(text, depth), '~', '$') as expanded from w group by name""")
def v03(spark, sf_dir):
    return variables.expand_values(derived(spark, sf_dir, _NESTED))


@query("v01_generated_variables", _BASE + f""", f as (select path, max_by({_T}, line_no) filter (where name = 'module') as module, max_by({_T}, line_no) filter (where name = 'summary' and symbol is null) as summary,
max_by({_T}, line_no) filter (where name = 'layer') as layer, max_by({_T}, line_no) filter (where name = 'domain') as domain from scoped group by path),
s as (select path, symbol, opener_line, max_by({_T}, line_no) filter (where name = 'summary' and line_no > opener_line) as summary from scoped where symbol is not null group by all)
select 'SYM_' || upper(symbol) as name, 'symbol' as type, path || ':' || symbol as value, summary as description from s
union all select 'DOM_' || upper(domain), 'domain', domain, 'Domain: ' || domain || ' (' || count(*) || ' files)' from f group by domain
union all select 'FILE_' || upper(regexp_replace(path, '[/.]', '_', 'g')), 'file', path, coalesce(summary, module) from f
union all select 'LAYER_' || upper(layer), 'layer', layer, 'Layer: ' || layer || ' (' || count(*) || ' files)' from f group by layer""")
def v01(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    made = code_files.fold_files(notes)
    symbols = code_files.fold_symbols(notes).select("name", "qualified_name", "summary", "path", "exported")
    return variables.generate(symbols, made).drop("refs")


_SECTIONS = """select concat('s', cast(p_partkey as varchar(40))) as id, concat('c', cast(p_partkey % 5 as varchar(40))) as catalogue, cast(p_partkey as bigint) as ord, cast(10 + p_size as bigint) as tokens,
p_size * 5 % 101 as safety, p_size * 3 % 101 as efficiency, p_size * 7 % 101 as accuracy, 50 as base, p_partkey % 40 = 0 as required, p_partkey % 37 = 0 as wanted, cast(p_partkey % 3 * 50 as bigint) as priority, p_partkey % 4 as m from part"""


def _sections(spark, sf_dir):
    rows = derived(spark, sf_dir, _SECTIONS)
    kind = "array<struct<dimension:string,add:int,multiply:double,set:int,active:boolean>>"
    made = (
        F.when(F.col("m") == 1, F.from_json(F.lit('[{"dimension":"safety","add":200,"active":true}]'), kind))
        .when(F.col("m") == 2, F.from_json(F.lit('[{"dimension":"all","multiply":0.5,"active":true},{"dimension":"base","set":300,"active":true}]'), kind))
        .otherwise(F.from_json(F.lit('[{"dimension":"base","add":-70,"active":true},{"dimension":"safety","set":0,"active":false}]'), kind))
    )
    return primer.score(rows.withColumn("modifiers", made), "safe", "modifiers")


@query("r01_r02_section_scores", f"""with s as ({_SECTIONS}), d as (select id, tokens, case m when 1 then least(safety + 200, 255) when 2 then safety // 2 else safety end as safety,
case m when 2 then efficiency // 2 else efficiency end as efficiency, case m when 2 then accuracy // 2 else accuracy end as accuracy, case m when 1 then base when 2 then 255 else 0 end as base from s)
select id, round(safety * 2.5::double + efficiency * 0.8::double + accuracy * 1.0::double + base * 0.8::double, 6) as value,
round((safety * 2.5::double + efficiency * 0.8::double + accuracy * 1.0::double + base * 0.8::double) / tokens, 6) as density from d""")
def r01(spark, sf_dir):
    return _sections(spark, sf_dir).select("id", F.round("value", 6).alias("value"), F.round("density", 6).alias("density"))


@query("r05_section_selection")
def r05(spark, sf_dir):
    none = F.array().cast("array<string>")
    rows = _sections(spark, sf_dir).withColumns({"depends": F.when(F.col("ord") % 11 == 0, F.array(F.concat(F.lit("s"), (F.col("ord") - 5).cast("string")))).otherwise(none), "conflicts": F.when(F.col("ord") % 13 == 0, F.array(F.concat(F.lit("s"), (F.col("ord") + 5).cast("string")))).otherwise(none)})
    return primer.select_sections(rows, 2000)


@query("r06_tiers", "select o_orderkey, case when o_orderkey % 900 < 300 then 'micro' when o_orderkey % 900 < 450 then 'minimal' when o_orderkey % 900 < 700 then 'standard' else 'full' end as tier from orders")
def r06(spark, sf_dir):
    return derived(spark, sf_dir, "select o_orderkey from orders").select("o_orderkey", primer.tier(F.col("o_orderkey") % 900).alias("tier"))


@query("r04_dynamic_tokens", "select o_orderkey, least(o_orderkey % 30, 10) * (5 + o_orderkey % 7) as tokens from orders")
def r04(spark, sf_dir):
    rows = derived(spark, sf_dir, "select o_orderkey from orders")
    return rows.select("o_orderkey", primer.dynamic_tokens(F.col("o_orderkey") % 30, 5 + F.col("o_orderkey") % 7, F.lit(None).cast("long")).alias("tokens"))


@query("s09_merged_sections", """with b as (select 's' || s_suppkey as id, 'base' as origin, s_suppkey % 7 as tokens from supplier), p as (select 's' || (s_suppkey * 2) as id, 'project' as origin, s_suppkey % 5 as tokens from supplier),
m as (select * from b where id not in (select id from p) union all select * from p) select id, origin, case when id = 's4' then 99 else tokens end as tokens from m where id <> 's6'""")
def s09(spark, sf_dir):
    base = derived(spark, sf_dir, "select concat('s', cast(s_suppkey as varchar(40))) as id, 'base' as origin, s_suppkey % 7 as tokens from supplier")
    project = spark.sql("select concat('s', cast(s_suppkey * 2 as varchar(40))) as id, 'project' as origin, s_suppkey % 5 as tokens from supplier")
    overrides = spark.sql("select 's4' as id, cast(99 as bigint) as tokens")
    return primer.apply_overrides(primer.merge_sections(base, project), overrides, ["tokens"], ["s6"])


_LANGUAGE = "case o_orderkey % 6 when 0 then 'typescript' when 1 then 'python' when 2 then 'rust' when 3 then 'go' when 4 then 'java' else 'ruby' end"
_DOC = f"""select o_orderkey as id, {_LANGUAGE} as language, case o_orderkey % 5 when 0 then concat('@param x the x', chr(10)) when 1 then concat('Args:', chr(10), '  x: y')
when 2 then concat('Parameters', chr(10), '----------') when 3 then ':param x: y' else '/// plain' end as content from orders"""


@query("b01_format_detection", rf"""with d as ({_DOC}) select id, case language when 'typescript' then case when regexp_matches(content, '@param') then 'jsdoc' end
when 'python' then case when regexp_matches(content, 'Parameters\n-{{3,}}') then 'docstring:numpy' when regexp_matches(content, ':param ') then 'docstring:sphinx' when regexp_matches(content, 'Args:') then 'docstring:google' end
when 'rust' then case when contains(content, '///') then 'rustdoc' end when 'go' then 'godoc' when 'java' then 'javadoc' end as format from d""")
def b01(spark, sf_dir):
    return derived(spark, sf_dir, _DOC).select("id", bridge.detect(F.col("content"), F.col("language")).alias("format"))


_PAIRS = """select cast(o_orderkey as varchar(40)) as key, case when o_orderkey % 3 <> 0 then o_orderpriority end as native, case when o_orderkey % 4 <> 0 then case o_orderkey % 2 when 0 then o_orderpriority else o_orderstatus end end as noted, case when o_orderkey % 8 < 5 and o_orderkey % 4 <> 0 then 'do' end as directive from orders"""


@query("b02_b05_merged_summaries", f"""with p as ({_PAIRS}) select key, case when native is null then noted when noted is null and directive is null then native when noted is not null and noted <> native then native || ' ' || noted else native end as summary,
directive, case when native is null then 'explicit' when noted is null and directive is null then 'converted' else 'merged' end as source from p""")
def b05(spark, sf_dir):
    return bridge.merge_summaries(derived(spark, sf_dir, _PAIRS), PRECEDENCES[2])


@query("b03_annotated_first", f"""with p as ({_PAIRS}) select key, coalesce(native, noted) as summary, directive, case when native is null then 'explicit' when noted is null and directive is null then 'converted' else 'merged' end as source from p""")
def b03(spark, sf_dir):
    return bridge.merge_summaries(derived(spark, sf_dir, _PAIRS), PRECEDENCES[0])


_NATIVE = "select distinct concat('k', cast(l_orderkey % 900 as varchar(40))) as key, cast(l_linenumber as bigint) as ord, concat('p', cast(l_linenumber as varchar(40))) as name, 'string' as type, concat('t', cast(l_linenumber as varchar(40))) as text from lineitem where l_linenumber < 5"
_NOTED = "select distinct concat('k', cast(l_orderkey % 1100 as varchar(40))) as key, cast(l_linenumber as bigint) as ord, concat('p', cast(l_linenumber as varchar(40))) as name, concat('d', cast(l_linenumber as varchar(40))) as directive from lineitem where l_linenumber > 2"


@query("b06_merged_parameters", f"""with n as ({_NATIVE}), a as ({_NOTED}) select coalesce(n.key, a.key) as key, coalesce(n.name, a.name) as name, n.type, n.text, a.directive,
case when n.key is null then 'explicit' when a.key is null then 'converted' else 'merged' end as source from n full join a on n.key = a.key and n.name = a.name""")
def b06(spark, sf_dir):
    native = derived(spark, sf_dir, _NATIVE)
    return bridge.merge_entries(native, spark.sql(_NOTED)).drop("place")


@query("b04_native_first_parameters", f"""with n as ({_NATIVE}), a as ({_NOTED}) select n.key, n.name, n.type, n.text, a.directive, case when a.key is null then 'converted' else 'merged' end as source from n left join a on n.key = a.key and n.name = a.name""")
def b04(spark, sf_dir):
    native = derived(spark, sf_dir, _NATIVE)
    return bridge.merge_entries(native, spark.sql(_NOTED), PRECEDENCES[1]).drop("place")


_BRIDGED = f"""select {_LANGUAGE} as detected_format, cast(o_orderkey % 3 as bigint) as explicit_count, cast(o_orderkey % 5 as bigint) as converted_count, cast(o_orderkey % 2 as bigint) as merged_count from orders"""


@query("b11_bridge_stats", f"""with b as ({_BRIDGED}) select coalesce(detected_format, 'all') as format, cast(sum(explicit_count) as bigint) as explicit, cast(sum(converted_count) as bigint) as converted, cast(sum(merged_count) as bigint) as merged,
cast(sum(converted_count + merged_count) as bigint) as documented from b group by grouping sets ((detected_format), ())""")
def b11(spark, sf_dir):
    return stats.bridge_stats(derived(spark, sf_dir, _BRIDGED))


_JS = """select o_orderkey as target, concat('/**', chr(10), ' * Order ', cast(o_orderkey as varchar(40)), ' text.', chr(10), ' * @param {string} a', cast(o_orderkey % 7 as varchar(40)), ' - the ', o_orderstatus, chr(10), ' * @returns {number} result', chr(10),
case when o_orderkey % 2 = 0 then concat(' * @deprecated use b', chr(10)) else '' end, case when o_orderkey % 3 = 0 then concat(' * @see C', cast(o_orderkey as varchar(40)), chr(10)) else '' end, ' */') as text from orders"""


@query("d01_jsdoc", f"""with d as ({_JS}) select target, 'Order ' || target || ' text.' as summary, 'a' || (target % 7) as param, 'string' as type, case when target % 2 = 0 then 'use b' end as deprecated, case when target % 3 = 0 then 'C' || target else '' end as see from d""")
def d01(spark, sf_dir):
    rows = derived(spark, sf_dir, _JS)
    parsed = rows.select("target", docs.column(F.col("text"), F.lit("jsdoc")).alias("doc"))
    first = F.get("doc.params", F.lit(0))
    return parsed.select("target", F.col("doc.summary").alias("summary"), first["name"].alias("param"), first["type"].alias("type"), F.col("doc.deprecated").alias("deprecated"), F.array_join("doc.see", ",").alias("see"))


@query("d06_converted_suggestions", f"""with d as ({_JS}) select target, 'summary' as kind, 'Order ' || target || ' text.' as value from d union all select target, 'deprecated', 'use b' from d where target % 2 = 0 union all select target, 'ref', 'C' || target from d where target % 3 = 0""")
def d06(spark, sf_dir):
    rows = derived(spark, sf_dir, _JS)
    parsed = rows.select("target", F.lit(1).alias("line"), docs.column(F.col("text"), F.lit("jsdoc")).alias("doc"))
    return bridge.suggestions(parsed).select("target", "kind", "value")


_ATTEMPTS = """select concat('a', cast(user_id as varchar(40))) as id, case event_type when 'click' then 'active' when 'view' then 'testing' when 'error' then 'failed' when 'purchase' then 'verified' else 'reverted' end as status, ts, event_id as seq from events"""


@query("t01_attempt_state", f"""with e as ({_ATTEMPTS}), l as (select id, max_by(status, (ts, seq)) as status, count(*) as events, min(ts) as a, max(ts) as b from e group by id)
select id, status, events, cast(epoch_us(a) as bigint) as created_us, cast(epoch_us(b) as bigint) as updated_us from l where status not in ('verified', 'reverted')""")
def t01(spark, sf_dir):
    made = attempts.state(derived(spark, sf_dir, _ATTEMPTS))
    return made.select("id", "status", "events", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"), F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"))


@query("t01_attempt_history", f"""with e as ({_ATTEMPTS}), h as (select *, coalesce(lag(ts) over (partition by id order by ts, seq), ts) as s from e)
select id, status, cast(epoch_us(s) as bigint) as started_us, cast(epoch_us(ts) as bigint) as ended_us from h where status in ('failed', 'verified', 'reverted')""")
def t01_history(spark, sf_dir):
    made = attempts.history(derived(spark, sf_dir, _ATTEMPTS))
    return made.select("id", "status", F.unix_micros(F.col("started_at").cast("timestamp")).alias("started_us"), F.unix_micros(F.col("ended_at").cast("timestamp")).alias("ended_us"))


@query("t01_modifications", "select cast(page_id as varchar) as path, md5(html) as original_hash, md5(url) as modified_hash, case when strlen(html) <= 100000 then html end as original_content from pages")
def t01_modified(spark, sf_dir):
    rows = derived(spark, sf_dir, "select cast(page_id as string) as path, html as before, url as after from pages")
    return attempts.modification(rows)


@query("c01_violations", """with f as (select c_custkey, case c_custkey % 4 when 0 then 'python' when 1 then 'cobol' when 2 then 'go' end as language, c_custkey % 20 - 1 as lines from customer)
select c_custkey as key, 'unknown language' as message from f where language = 'cobol' union all select c_custkey, 'negative lines' from f where lines < 0""")
def c01(spark, sf_dir):
    rows = derived(spark, sf_dir, "select c_custkey, cast(c_custkey as string) as path, case c_custkey % 4 when 0 then 'python' when 1 then 'cobol' when 2 then 'go' end as language, c_custkey % 20 - 1 as lines from customer")
    return validation.violations(rows, "files", "c_custkey")


@query("f21_document_kinds", "select s_suppkey, case s_suppkey % 4 when 0 then 'cache' when 1 then 'attempts' when 2 then 'primer' end as kind from supplier")
def f21(spark, sf_dir):
    rows = derived(spark, sf_dir, "select s_suppkey, case s_suppkey % 4 when 0 then '.x.Cache.json' when 1 then 'my.attempts.json' else 'a.json' end as name, case s_suppkey % 4 when 2 then 'https://h/primer.schema.json' end as link from supplier")
    return rows.select("s_suppkey", validation.kind_of(F.col("name"), F.col("link")).alias("kind"))


@query("d05_page_links", r"""select page_id, regexp_replace(html, '<[^>]+>', '', 'g') as plain, array_to_string(regexp_extract_all(html, 'href="([^"]+)"', 1), ',') as links from pages""")
def d05(spark, sf_dir):
    rows = derived(spark, sf_dir, "select page_id, html from pages")
    return rows.select("page_id", F.regexp_replace("html", "<[^>]+>", "").alias("plain"), F.array_join(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1), ",").alias("links"))
