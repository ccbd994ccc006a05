"""Every registered query with SQL agrees with DuckDB over the smallest tables."""

import os

import pytest

from clipwright.jobs import registry

SF = "/root/testdata/sf0.001"


def told(x):
    return "null" if x is None or x != x else repr(round(x, 9) + 0.0) if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    if name in registry.ORACLES:
        found = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(names)
        cols = sorted(names)
        assert sorted(tuple(told(r[c]) for c in cols) for r in rows) == sorted(tuple(told(r[names.index(c)]) for c in cols) for r in found.fetchall())
