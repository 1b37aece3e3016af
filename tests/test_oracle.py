"""Every SQL-checkable registered query against DuckDB on sf0.001."""

import datetime as dt
import math
import re

import duckdb
import pytest

import __spark_entry__ as E
from tabforge.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
# the training-data queries have tests of their own
CORE = sorted(q for q in E.queries() if not re.match(r"op\d+_|pipeline$", q))


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", [q for q in CORE if q in E.oracle_sql()])
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF)
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(rel.columns, rel.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 8 and df.columns[0] == "column"


def test_every_query_has_a_callable():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_negative_zero_rewrite():
    sql = "select round(a, 6) x, round((b - round(c, 2)) / d, 6) y, 'round(q' z, around(1) from t"
    assert E._fold_negative_zero(sql) == (
        "select (round(a, 6) + 0.0) x, (round((b - (round(c, 2) + 0.0)) / d, 6) + 0.0) y, "
        "'round(q' z, around(1) from t")


ROWS_ONLY = sorted(set(CORE) - set(E.oracle_sql()))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query_runs(spark, name):
    df = E.queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_query_names():
    for name in E.queries():
        assert re.fullmatch(r"[a-z][a-z0-9_]*", name)
