"""Every query with SQL against DuckDB over the same tables; the others run."""

import glob
import math
import os

import duckdb
import pytest

from srcatlas.plans import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    yield con
    con.close()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    made = QUERIES[name](spark, sf_dir)
    got = rows(made.columns, [tuple(r) for r in made.collect()])
    if name not in ORACLE:
        assert got
        return
    answer = duck.sql(ORACLE[name])
    assert sorted(made.columns) == sorted(answer.columns)
    assert got == rows(answer.columns, answer.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    if not os.path.isdir(entry.SMOKE):
        pytest.skip("no test tables")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
