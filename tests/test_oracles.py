"""Every registered catalog query against its SQL on DuckDB."""

import datetime
import decimal
import math

import duckdb
import pytest

from catascope import queries as catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)[:26] if isinstance(v, (datetime.datetime, datetime.date)) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(name, spark, duck, sf_dir):
    df = catalog.queries()[name](spark, sf_dir)
    r = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(r.columns)
    order = sorted(df.columns)
    ours = sorted((tuple(plain(x[c]) for c in order) for x in df.collect()), key=repr)
    at = [r.columns.index(c) for c in order]
    theirs = sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
    assert ours == theirs
