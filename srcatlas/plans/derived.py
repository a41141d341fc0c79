"""Source-code relations derived from the driver's tables.

The texts are SQL that Spark and DuckDB read alike, so a query and its oracle
start from the same rows.  Counters are BIGINT in both.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MARKER as M

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


def _s(column: str) -> str:
    return f"cast({column} as varchar(40))"


_O, _C = "o_orderkey", "o_custkey"
_DIR = f"case {_C} % 5 when 0 then 'auth' when 1 then 'billing' when 2 then 'db' when 3 then 'utils' else 'handlers' end"
_EXT = f"case {_O} % 5 when 0 then '.ts' when 1 then '.py' when 2 then '.rs' when 3 then '.go' else '.java' end"
_PATH = f"concat('src/', {_DIR}, '/m', {_s(_O)}, {_EXT})"
_LOCK = (
    f"case {_O} % 9 when 0 then 'frozen' when 1 then 'restricted' when 2 then 'approval-required' when 3 then 'tests-required' "
    f"when 4 then 'docs-required' when 5 then 'review-required' when 6 then 'experimental' when 7 then 'odd' else 'normal' end"
)
_ORIGIN = f"case {_O} % 5 when 0 then 'explicit' when 1 then 'converted' when 2 then 'heuristic' when 3 then 'refined' else 'inferred' end"
_LAYER = f"case {_O} % 3 when 0 then 'service' when 1 then 'handler' else 'model' end"

_LINES = (
    f"concat('// {M}module \"Module ', {_s(f'{_C} % 50')}, '\"')",
    f"concat('// {M}domain d', {_s(f'{_C} % 7')})",
    f"concat('// {M}lock ', {_LOCK}, case when {_O} % 3 = 0 then ' - keep it stable' else '' end)",
    f"case when {_O} % 4 = 0 then '//   and ask first' else 'import x' end",
    f"concat('// {M}summary \"Order ', {_s(_O)}, ' file\"')",
    f"case when {_O} % 2 = 0 then concat('// {M}source ', {_ORIGIN}) else 'let a = 1;' end",
    f"case when {_O} % 2 = 0 and {_O} % 10 <> 0 then concat('// {M}source-confidence 0.', {_s(f'{_O} % 90 + 10')}) else '' end",
    f"case when {_O} % 6 = 0 then '// {M}source-reviewed true' else '' end",
    f"concat('// {M}layer ', {_LAYER})",
    f"case when {_O} % 7 = 0 then '// {M}ai-careful \"touches money\"' else '' end",
    f"concat('// {M}imports ./m', {_s(f'{_O} + 25')}, ', ../', {_DIR}, '/m', {_s(f'({_O} * 3) % 1500')}, ', lodash')",
    f"concat('// {M}fn \"f', {_s(_O)}, '\" - does step ', {_s(f'{_O} % 11')})",
    f"concat('// {M}summary \"Symbol f', {_s(_O)}, '\"')",
    f"concat('// {M}calls f', {_s(f'({_O} * 7) % 1000')}, ', f', {_s(f'({_O} * 13 + 1) % 1000')})",
    f"concat('// {M}param {{string}} [name', {_s(f'{_O} % 4')}, '=x] - the name')",
    f"case when {_O} % 4 = 1 then '// {M}returns {{number}}' else '// {M}template T extends Base' end",
    f"case when {_O} % 3 = 1 then '// {M}pure' else '' end",
    f"case when {_O} % 5 = 2 then '// {M}deprecated - use g' else '' end",
    f"concat('// {M}class \"C', {_s(_O)}, '\"')",
    f"case when {_O} % 6 = 0 then concat('// {M}hack expires=2024-0', {_s(f'{_O} % 9 + 1')}, '-15 ticket=T-', {_s(_O)}, ' \"why ', {_s(_O)}, '\"') else '' end",
    f"case when {_O} % 5 = 1 then '// {M}todo \"later on\"' else '' end",
    "'end'",
)

#: path, content: one annotated source file per order.
CODE_FILES = f"select {_O}, {_C}, {_PATH} as path, concat({', chr(10), '.join(_LINES)}) as content from orders"
#: The same from orders that have their path already.
_PLACED_FILES = CODE_FILES.replace(f"{_PATH} as path", "path")

#: caller, callee, path, line_no: a bag of calls.
CALL_EDGES = "select concat('f', cast(l_orderkey as varchar(40))) as caller, concat('f', cast(l_partkey as varchar(40))) as callee, 'src' as path, cast(l_linenumber as bigint) as line_no from lineitem"

#: target, key, source, confidence, needs_review, reviewed.
PROVENANCE = """select concat('t', cast(event_id as varchar(40))) as target, event_type as key,
case event_type when 'click' then 'explicit' when 'error' then 'converted' when 'purchase' then 'heuristic' when 'signup' then 'refined' else 'inferred' end as source,
case when user_id % 10 = 0 then null else cast(event_id % 101 as double) / 100 end as confidence,
case when user_id % 10 = 0 then false else event_id % 101 < 80 end as needs_review,
event_id % 4 = 0 as reviewed from events"""

#: path, author, ts, added, removed, commit_id: version-control history.
COMMITS = """select concat('c', cast(o_custkey as varchar(40))) as path, o_orderpriority as author, o_orderdate as ts,
cast(o_orderkey % 40 as bigint) as added, cast(o_orderkey % 17 as bigint) as removed, concat('k', cast(o_orderkey as varchar(40))) as commit_id from orders"""

#: path, line_no, author, ts, commit_id: one row per path and line.
BLAME = """select concat('c', cast(l_orderkey % 500 as varchar(40))) as path, cast(l_linenumber as bigint) as line_no, l_returnflag as author, max(l_shipdate) as ts
from lineitem group by l_orderkey % 500, l_linenumber, l_returnflag"""

#: path, name, line_start, line_end.
RANGES = """select distinct concat('c', cast(o_orderkey % 500 as varchar(40))) as path, concat('s', cast(o_orderkey % 1500 as varchar(40))) as name,
cast(1 + o_orderkey % 3 as bigint) as line_start, cast(4 + o_orderkey % 4 as bigint) as line_end from orders"""

#: name, refs: a dictionary whose references form a bounded tree and one planted cycle.
VARIABLES = """select concat('V', cast(p_partkey as varchar(40))) as name, p_name as value, case p_partkey % 3 when 0 then 'symbol' when 1 then 'file' else 'domain' end as type,
p_type as description, p_partkey as id from part"""


_read: dict[tuple, dict[str, DataFrame]] = {}


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views for the driver's tables, whose schemas are read once for each session and folder."""
    key = (spark.sparkContext.applicationId, spark._jsparkSession.hashCode(), sf_dir)
    if key not in _read:
        _read[key] = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}
    for name, rows in _read[key].items():
        rows.createOrReplaceTempView(name)


#: Rows of a task that makes and parses texts of them.
TASK_ROWS = 50_000


def tasks(rows: DataFrame) -> int:
    """As many tasks as use all cores and keep each short."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / TASK_ROWS))


def spread(rows: DataFrame) -> DataFrame:
    """Rows over so many tasks, where a table has fewer splits than those."""
    wanted = tasks(rows)
    return rows.repartition(wanted) if rows.rdd.getNumPartitions() < wanted else rows


def dealt(rows: DataFrame, column: str) -> DataFrame:
    """Rows dealt out by a column to so many tasks: what is keyed by it needs no other shuffle."""
    return rows.repartition(tasks(rows), column)


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(sql)


def sources(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Source texts made of orders, which are spread before the texts are made and parsed."""
    register(spark, sf_dir)
    spread(spark.table("orders")).createOrReplaceTempView("orders")
    return spark.sql(sql)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``CODE_FILES``; orders are dealt out by path before the texts are made, so what is keyed by path stays in its task."""
    register(spark, sf_dir)
    orders = spark.table("orders").withColumn("path", F.expr(_PATH))
    orders.repartition(tasks(orders), "path").createOrReplaceTempView("orders")
    return spark.sql(_PLACED_FILES)
