"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from sessionflow import queries

from .test_independent import CHECKED

TABLES = "region nation customer supplier part orders lineitem events".split()
SQL = queries.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    return duckdb.connect()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf, duck, name):
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    got = sorted(([norm(r[c]) for c in columns] for r in df.collect()), key=str)
    if name not in SQL:
        assert name in CHECKED and got  # ``test_independent`` holds its rows against plain Python
        return
    for t in TABLES:
        duck.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(([norm(r[i]) for i in order] for r in rel.fetchall()), key=str)
    assert got == want


def test_most_queries_have_sql():
    assert set(SQL) <= set(queries.queries()) and len(SQL) > 70
