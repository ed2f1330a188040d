"""Every registered query of the library gives what its SQL gives."""

import os

import duckdb
import pytest

from foliant.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equal(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())
    result = duck.execute(f"SELECT * FROM ({catalog.ORACLE_SQL[name]})")
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
