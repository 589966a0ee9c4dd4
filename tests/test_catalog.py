"""Each query of the core against its SQL in DuckDB on the smallest tables."""

import os

import pytest

from stratalog.plans import catalog

parity = pytest.importorskip("parity")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return parity.oracle(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    got = parity.same(df.columns, [tuple(r) for r in df.collect()])
    if sql := catalog.oracle_sql().get(name):
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert got == parity.same(names, cur.fetchall())
