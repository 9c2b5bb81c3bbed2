"""Every query of the engine against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from framewright import catalog


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if x != x else f"{x:.9g}"
    return None if x is None else str(x)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    out = catalog.QUERIES[name](spark, sf)
    got = rows(out.columns, out.collect())
    if name in catalog.ORACLE_SQL:
        r = duck.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == sorted(out.columns)
        assert got == rows(names, r.fetchall())
