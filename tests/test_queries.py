"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tsloom.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return c


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLES])
def test_against_sql(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in found.fetchall()), key=str)
    assert got == want and got


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).count() == 12
